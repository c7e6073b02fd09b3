"""Pairwise work on vectors, in blocks.

Vectors are dealt into blocks of about BLOCK rows. Every pair of blocks is a key of its own, to which both blocks are sent, so pairs
of blocks spread over all tasks however large a group is, and matrix products do a pair in numpy, by tiles of BLOCK rows. No pair of
rows is ever made by a join, and operators that need sums of distances, quantiles, or the nearest rows, let only these leave a task.

A vector is sent to every block of its group, so blocks of vectors grow with the group once there are GRID of them, up to NUMBERS
numbers: what is sent is some GRID times the input, not the square of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

BLOCK, GRID, NUMBERS = 512, 12, 1 << 20


def blocks(rows: DataFrame, size: int = BLOCK, *more: str, wide: bool = False) -> DataFrame:
    """rows(grp, id, v, more...) -> (grp, blks, blk, ids, flat, n, more as arrays): blocks of about `size` vectors of a group, by a
    hash of the id; blks is how many the group has. Wide blocks are larger where a group would have more than GRID."""
    n = F.count(F.lit(1))
    blks = F.ceil(n / size)
    if wide:
        blks = F.least(blks, F.greatest(F.lit(GRID), F.ceil(n * F.max(F.size("v")) / NUMBERS)))
    counts = rows.groupBy("grp").agg(F.greatest(F.lit(1), blks).alias("blks"))
    dealt = rows.join(counts, "grp").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blks")))
    held = dealt.groupBy("grp", "blks", "blk").agg(F.collect_list(F.struct("id", "v", *more)).alias("r"))
    return held.select(
        "grp", "blks", "blk", F.transform("r", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias("flat"), F.size("r").alias("n"),
        *[F.col("r")[c].alias(c) for c in more],
    )


def block_pairs(rows: DataFrame, size: int, *more: str, wide: bool = False) -> DataFrame:
    """Pairs of blocks of a group, each pair once, blk_a <= blk_b."""
    return _paired(blocks(rows, size, *more, wide=wide), *more)


def _paired(b: DataFrame, *more: str) -> DataFrame:
    carried = ("ids", "flat", "n", *more)
    left = b.select("grp", F.col("blk").alias("blk_a"), F.explode(F.sequence("blk", F.col("blks") - 1)).alias("blk_b"), *[F.col(c).alias(f"{c}_a") for c in carried])
    right = b.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "blk")).alias("blk_a"), F.col("blk").alias("blk_b"), *[F.col(c).alias(f"{c}_b") for c in carried])
    met = left.join(right, ["grp", "blk_a", "blk_b"])
    # a block is gathered once for each side, and executors send its rows in any order: with itself it meets in one order
    same = F.col("blk_a") == F.col("blk_b")
    return met.withColumns({f"{c}_b": F.when(same, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in carried})


def cosine_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300)
    out[na == 0] = 0
    out[:, nb == 0] = 0
    return out


def euclidean_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) if a.shape[1] <= 8 else _expanded(a, b), 0))


def _expanded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.where(out < 1e-9, 0.0, out)


def combined_kernel(a: np.ndarray, b: np.ndarray, split: int, sem: float = 0.7, cov: float = 0.3) -> np.ndarray:
    return sem * cosine_kernel(a[:, :split], b[:, :split]) + cov * cosine_kernel(a[:, split:], b[:, split:])


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for r in range(batch.num_rows):
        get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
        na, nb = batch.column("n_a")[r].as_py(), batch.column("n_b")[r].as_py()
        same = batch.column("blk_a")[r].as_py() == batch.column("blk_b")[r].as_py()
        yield batch.column("grp")[r].as_py(), get("ids_a"), get("ids_b"), get("flat_a").astype(float).reshape(na, -1), get("flat_b").astype(float).reshape(nb, -1), same


def _tiles(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """The parts of BLOCK rows of two blocks, each pair of parts once; whether both are the same rows."""
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            yield slice(i, i + BLOCK), slice(j, j + BLOCK), same and i == j


def _scored(batches: Iterator[pa.RecordBatch], kernel: Callable, least: float | None, most: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, ids_a, ids_b, va, vb, whole in _blocks_of(batch):
            for p, q, same in _tiles(va, vb, whole):
                ia, ib, s = ids_a[p], ids_b[q], kernel(va[p], vb[q])
                ok = ia[:, None] < ib[None, :] if same else np.ones(s.shape, bool)
                if least is not None:
                    ok &= s >= least
                if most is not None:
                    ok &= s <= most
                i, j = np.nonzero(ok)
                x, y = ia[i], ib[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), grp, np.int64)), pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64()), pa.array(s[i, j], pa.float64())], ["grp", "a", "b", "score"]
                )


def pair_scores(rows: DataFrame, kernel: Callable = cosine_kernel, least: float | None = None, most: float | None = None, size: int = BLOCK) -> DataFrame:
    """rows(grp, id, v) -> (grp, a, b, score) of all pairs a < b of a group whose score lies in [least, most]."""
    return block_pairs(rows, size, wide=True).mapInArrow(partial(_scored, kernel=kernel, least=least, most=most), "grp long, a long, b long, score double")


#: How many of the 64 bits that order scores are left after each pass of pair_quantiles.
SHIFTS = (48, 34, 0)
_BINS = "grp long, parent long, bin long, n long, score double, mean double, squares double, low double, high double"


def _order(s: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = (s + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _counted(batches: Iterator[pa.RecordBatch], kernel: Callable, above: int, shift: int) -> Iterator[pa.RecordBatch]:
    """How many scores of a group lie in each bin, a bin being scores of equal leading bits. First of all scores, with rows (bin null)
    of each pair of blocks' count, mean, squared deviations and range; then of those in the bins given by `inside`. Without bits
    left a bin is one score."""
    schema, held = pa.schema([(c, pa.int64() if k == "long" else pa.float64()) for c, k in (x.split() for x in _BINS.split(", "))]), {}

    def rows(**columns) -> pa.RecordBatch:
        n = max(len(x) for x in columns.values())
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def out() -> Iterator[pa.RecordBatch]:
        for (grp, parent), n in held.items():
            at = np.flatnonzero(n)
            yield rows(grp=np.full(len(at), grp), parent=np.full(len(at), parent), bin=at + ((parent << (above - shift)) if above < 64 else -(1 << 15)), n=n[at])
        held.clear()

    for batch in batches:
        for r, (grp, ids_a, ids_b, va, vb, whole) in enumerate(_blocks_of(batch)):
            single, moments = {}, []
            for p, q, same in _tiles(va, vb, whole):
                s = kernel(va[p], vb[q])
                s = s[ids_a[p][:, None] < ids_b[q][None, :]] if same else s.ravel()
                if not len(s):
                    continue
                key = _order(s)
                if above == 64:
                    mean = s.mean()
                    moments.append((len(s), mean, float(np.square(s - mean).sum()), s.min(), s.max()))
                    held[grp, 0] = held.get((grp, 0), 0) + np.bincount((key >> shift) + (1 << 15), minlength=1 << 16)
                    continue
                top = key >> above
                for parent in batch.column("inside")[r].as_py():
                    of = top == parent
                    if shift:
                        held[grp, parent] = held.get((grp, parent), 0) + np.bincount((key[of] >> shift) - (parent << (above - shift)), minlength=1 << (above - shift))
                    else:
                        single.setdefault(parent, []).append(s[of])
            if moments:
                yield rows(grp=[grp] * len(moments), **dict(zip(("n", "mean", "squares", "low", "high"), map(list, zip(*moments, strict=True)), strict=True)))
            for parent, found in single.items():
                score, n = np.unique(np.concatenate(found) + 0.0, return_counts=True)
                yield rows(grp=np.full(len(n), grp), parent=np.full(len(n), parent), bin=_order(score), n=n, score=score)
            if len(held) > 64:
                yield from out()
    yield from out()


def pair_quantiles(rows: DataFrame, kernel: Callable, shares: list[float], size: int = BLOCK) -> DataFrame:
    """rows(grp, id, v) -> (grp, n, min, max, mean, std, quantiles) of the scores of all pairs a < b of a group that has any. Exact,
    with linear interpolation, and without a row for each pair: scores are counted by their leading bits, then by more bits inside
    the bins where the quantiles lie, until a bin is one score. Each pass scores all pairs anew."""
    spark = rows.sparkSession
    dealt = settle(blocks(rows, size, wide=True), "blocks")
    found = settle(_paired(dealt).mapInArrow(partial(_counted, kernel=kernel, above=64, shift=SHIFTS[0]), _BINS), "bins")
    m = found.where("bin is null")
    n, part = F.sum("n"), F.col("n") * F.col("mean")
    whole = m.groupBy("grp").agg(n.alias("total"), (F.sum(part) / n).alias("center"), F.min("low").alias("min"), F.max("high").alias("max"))
    whole = settle(whole, "whole")
    off = F.col("mean") - F.col("center")
    std = m.join(whole, "grp").groupBy("grp").agg(F.sqrt(F.sum(F.col("squares") + F.col("n") * off * off) / n).alias("std"))
    place = lambda i: (F.col("total") - 1) * shares[i // 2]
    ranks = [F.struct(F.lit(i).alias("k"), (F.floor(place(i)) if i % 2 == 0 else F.ceil(place(i))).alias("rest")) for i in range(2 * len(shares))]
    wanted = whole.select("grp", F.lit(0).cast("long").alias("parent"), F.inline(F.array(*ranks)))
    for above, shift in zip((64, *SHIFTS), SHIFTS, strict=False):
        if above < 64:
            inside = settle(wanted.groupBy("grp").agg(F.collect_set("parent").alias("inside")), "inside")
            found = _paired(dealt).join(inside, "grp").mapInArrow(partial(_counted, kernel=kernel, above=above, shift=shift), _BINS)
            # the shuffles of the pass before have no reader left
            spark.sparkContext._jvm.System.gc()
        bins = found.where("bin is not null").groupBy("grp", "parent", "bin").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
        upto = F.sum("n").over(Window.partitionBy("grp", "parent").orderBy("bin"))
        bins = bins.select("grp", "parent", "bin", "score", (upto - F.col("n")).alias("first"), upto.alias("upto"))
        met = wanted.drop("score").join(bins, ["grp", "parent"]).where("rest >= first and rest < upto")
        wanted = settle(met.select("grp", F.col("bin").alias("parent"), "k", (F.col("rest") - F.col("first")).alias("rest"), "score"), "wanted")
    each = wanted.groupBy("grp").agg(*[F.max(F.when(F.col("k") == i, F.col("score"))).alias(f"s{i}") for i in range(2 * len(shares))])
    out = whole.join(std, "grp").join(each, "grp")

    def between(t: int):
        low, high, f = F.col(f"s{2 * t}"), F.col(f"s{2 * t + 1}"), place(2 * t) - F.floor(place(2 * t))
        return F.when(low == high, low).otherwise((1 - f) * low + f * high)

    return out.select("grp", F.col("total").alias("n"), "min", "max", F.col("center").alias("mean"), "std", F.array(*[between(t) for t in range(len(shares))]).alias("quantiles"))


#: Sums that a pair of blocks holds at once; with more they leave it by tiles.
SUMS = 1 << 22


def _one_hot(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(labels, return_inverse=True)
    return names, (at[:, None] == np.arange(len(names))[None, :]).astype(float)


def _summed(batches: Iterator[pa.RecordBatch], kernel: Callable) -> Iterator[pa.RecordBatch]:
    def rows(ids: np.ndarray, own: np.ndarray, names: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, len(names)), pa.int64()), pa.array(np.repeat(own, len(names)), pa.int64()), pa.array(np.tile(names, len(ids)), pa.int64()), pa.array(sums.ravel()), pa.array(np.tile(n, len(ids)), pa.int64())],
            ["id", "own", "other", "total", "n"],
        )

    for batch in batches:
        for r, (_, ia, ib, a, b, whole) in enumerate(_blocks_of(batch)):
            la = batch.column("labels_a")[r].values.to_numpy(zero_copy_only=False)
            lb = batch.column("labels_b")[r].values.to_numpy(zero_copy_only=False)
            names_a, count_a = np.unique(la, return_counts=True)
            names_b, count_b = np.unique(lb, return_counts=True)
            held = len(la) * len(names_b) + len(lb) * len(names_a) <= SUMS
            sums_a, sums_b = (np.zeros((len(la), len(names_b))), np.zeros((len(lb), len(names_a)))) if held else (None, None)
            for p, q, same in _tiles(a, b, whole):
                d = kernel(a[p], b[q])
                sides = [(p, q, ia, la, lb, d, sums_a, names_b)]
                if not same:
                    sides.append((q, p, ib, lb, la, d.T, sums_a, names_b) if whole else (q, p, ib, lb, la, d.T, sums_b, names_a))
                for x, y, ids, own, other, m, sums, names in sides:
                    few, hot = _one_hot(other[y])
                    if held:
                        sums[x, np.searchsorted(names, few)] += m @ hot
                    else:
                        yield rows(ids[x], own[x], few, m @ hot, hot.sum(axis=0).astype(int))
            if held:
                yield rows(ia, la, names_b, sums_a, count_b)
                if not whole:
                    yield rows(ib, lb, names_a, sums_b, count_a)


def label_sums(rows: DataFrame, kernel: Callable = euclidean_kernel, size: int = BLOCK) -> DataFrame:
    """rows(id, v, label) -> (id, own, other, total, n): of each row the summed score to all rows of each label, itself
    included. Only sums leave the tasks: rows times labels."""
    keyed = rows.select(F.lit(0).cast("long").alias("grp"), "id", "v", F.col("label").cast("long").alias("labels"))
    out = block_pairs(keyed, size, "labels", wide=True).mapInArrow(partial(_summed, kernel=kernel), "id long, own long, other long, total double, n long")
    return out.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _hot_summed(batches: Iterator[pa.RecordBatch], kernel: Callable, labellings: int, labels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, (_, ia, ib, a, b, whole) in enumerate(_blocks_of(batch)):
            sides = []
            for s, ids in (("a", ia), ("b", ib)):
                at = np.array(batch.column(f"labels_{s}")[r].values.flatten()).reshape(len(ids), labellings)
                hot = np.zeros((len(ids), labels))
                hot[np.arange(len(ids))[:, None], at] = 1
                sides.append((ids, at, hot, np.zeros((len(ids), labels))))
            (_, _, hot_a, sums_a), (_, _, hot_b, sums_b) = sides
            for p, q, same in _tiles(a, b, whole):
                d = kernel(a[p], b[q])
                sums_a[p] += d @ hot_b[q]
                if not same:
                    (sums_a if whole else sums_b)[q] += d.T @ hot_a[p]
            for ids, at, _, sums in sides[:1] if whole else sides:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, at.T), *map(pa.array, sums.T)], ["id", *[f"k{t}" for t in range(labellings)], *[f"s{k}" for k in range(labels)]])


def hot_sums(rows: DataFrame, places: list, labels: int, kernel: Callable = euclidean_kernel, size: int = BLOCK) -> DataFrame:
    """rows(id, v, ...) with several labellings, whose labels are numbered through (places: a row's number in each) -> (id, k0.., s0..):
    of each row its numbers, and the summed score to all rows of each label, itself included. For few labels."""
    keyed = rows.select(F.lit(0).cast("long").alias("grp"), "id", "v", F.array(*[p.cast("long") for p in places]).alias("labels"))
    own, sums = [f"k{t}" for t in range(len(places))], [f"s{k}" for k in range(labels)]
    schema = ", ".join(["id long", *[f"{c} long" for c in own], *[f"{c} double" for c in sums]])
    out = block_pairs(keyed, size, "labels", wide=True).mapInArrow(partial(_hot_summed, kernel=kernel, labellings=len(places), labels=labels), schema)
    return out.groupBy("id").agg(*[F.max(c).alias(c) for c in own], *[F.sum(c).alias(c) for c in sums])


def _closest(batches: Iterator[pa.RecordBatch], kernel: Callable, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, ia, ib, a, b, whole in _blocks_of(batch):
            near_a, near_b = np.full((len(ia), k), np.inf), np.full((len(ib), k), np.inf)
            for p, q, same in _tiles(a, b, whole):
                d = kernel(a[p], b[q])
                if same:
                    np.fill_diagonal(d, np.inf)
                for near, x, m in [(near_a, p, d)] if same else [(near_a, p, d), (near_a if whole else near_b, q, d.T)]:
                    m = np.partition(m, k - 1, axis=1)[:, :k] if k < m.shape[1] else m
                    near[x] = np.sort(np.hstack([near[x], m]), axis=1)[:, :k]
            for ids, near in [(ia, near_a)] if whole else [(ia, near_a), (ib, near_b)]:
                i, j = np.nonzero(near < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(near[i, j], pa.float64())], ["id", "score"])


def nearest(rows: DataFrame, k: int, kernel: Callable = euclidean_kernel, size: int = BLOCK) -> DataFrame:
    """rows(id, v) -> (id, place, score) of the k nearest other rows, place from 1. Of each row only k distances leave a pair of
    blocks."""
    keyed = rows.select(F.lit(0).cast("long").alias("grp"), "id", "v")
    found = block_pairs(keyed, size, wide=True).mapInArrow(partial(_closest, kernel=kernel, k=k), "id long, score double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("score"))).where(F.col("place") <= k)

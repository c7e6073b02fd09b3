"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by the general pigeonhole.

Method. The 64 bits are dealt into parts, bits that move together into the same part. A pair within radius r must agree to
within t_i bits on some part i for any thresholds with sum t_i = r - parts + 1 (t_i = -1: the part is not probed). The
thresholds are set by dynamic programming over estimated candidate counts, taken from the exact histograms of all parts'
values. Each distinct fingerprint is sent to its part values (and those within t_i bits), rows that meet are verified by
their full distance inside the task, and only a spanning set of links leaves it, so a group of n copies gives O(n) rows.

Two rules share this. op10 links fingerprints of 3-word shingles that differ in at most 3 bits. similar_rule() links estimates
of similar texts by a second print; the pipeline doesn't use it.

The pipeline's stage links what op10 links, and all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Prints only find candidates there: BANDS bands of ROWS minimum hashes over the five-word shingles, of which a pair of
similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, 0.99995 at 0.8 wherever the edits stand, and then at most
SKETCH_LIMIT of the minima's bits may differ (4 deviations at 0.8). Within the components of the candidates links are verified
by the shingle sets themselves: all members with the component's first, then those that it doesn't link with all others, by
blocks of BLOCK members.

Thresholds of 2k - 1 and 2k are probed by sending each fingerprint to all values within k bits, so two meet half way.

A value that more than `most` distinct fingerprints share is divided again: its members differ in at most r of the free bits,
so of r + 1 blocks of free bits one must be equal. That repeats until groups are small; no row or pair is dropped.

Defined cases: null text counts as empty; texts without words have fingerprint zero, linked like any other; repeated rows
give repeated result rows; null doc_id is carried through and never is a component's smallest id unless all are null."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, cut, fresh_name, mix, read_table, spans, utf8, with_batch_rows
from .components import components

RADIUS, PARTS, WIDTH = 3, 4, 16
NEAR_RADIUS, NEAR_WORDS, NEAR_SIMILARITY = 11, 5, 0.8
#: Minimum hashes that find candidates of NEAR_SIMILARITY, and the members of a component that one task compares with others.
BANDS, ROWS, SKETCH_LIMIT, BLOCK = 25, 5, 26, 128
#: Distinct prints that one task compares with one another, and the sets of bits by which larger groups are divided, again and
#: again. What is larger even then is compared in one task, in blocks.
GROUP_MOST, MASKS_MOST = 1 << 14, 1 << 14


def _hashes(text: bytes, words: int, seed: int) -> list[int]:
    found = text.split()  # bytes: splits at \x20 and \x09-\x0D alone
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(b" ".join(found), seed)]
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -words])]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]


def _majority(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Of each run of hashes: the bits that are set in more than half of it."""
    out = np.zeros(len(lengths), np.uint64)
    lens = np.array(lengths)
    full = np.flatnonzero(lens)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.cumsum(lens[full]) - lens[full]
        counts = np.stack([bits[a : a + n].sum(axis=0, dtype=np.int64) for a, n in zip(begins, lens[full])])
        out[full] = np.packbits(2 * counts > lens[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


@dataclass(frozen=True)
class Rule:
    """Which prints are linked: columns fp (and s0, s1) of a row; fp within `strict` bits, or within `radius` bits with s0 and s1
    within `limit` bits together."""

    radius: int = RADIUS
    strict: int = RADIUS
    limit: int | None = None

    @property
    def columns(self) -> list[str]:
        return ["fp"] if self.limit is None else ["fp", "s0", "s1"]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a, b: (..., columns) of unsigned 64-bit numbers."""
        apart = np.bitwise_count(a[..., 0] ^ b[..., 0])
        if self.limit is None:
            return apart <= self.radius
        apart2 = np.bitwise_count(a[..., 1] ^ b[..., 1]) + np.bitwise_count(a[..., 2] ^ b[..., 2])
        return (apart <= self.strict) | ((apart <= self.radius) & (apart2 <= self.limit))

    def nodes(self, prints: np.ndarray) -> np.ndarray:
        """One number for each print: the fingerprint itself, or a hash of all columns."""
        out = prints[:, 0]
        for k in range(1, prints.shape[1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ prints[:, k])
        return np.ascontiguousarray(out).view(np.int64)


STRICT = Rule()


def similar_rule(similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS) -> Rule:
    """The Jaccard similarity of shingle sets as an angle of their vectors, and that as a share of 128 bits."""
    cosine = 2 * similarity / (1 + similarity)
    return Rule(radius, RADIUS, int(128 * np.arccos(cosine) / np.pi))


def _fingerprint(batches: Iterator[pa.RecordBatch], words: int, seed: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        prints = [np.zeros((0, len(rule.columns)), np.uint64)]
        for a, b in spans(offsets, CHUNK_BYTES // 2):
            low = LOWER[data[offsets[a] : offsets[b]]].tobytes()
            at = (offsets[a : b + 1] - offsets[a]).tolist()
            texts, columns = [low[s:e] for s, e in zip(at, at[1:])], []
            for width in [words] if rule.limit is None else [words, NEAR_WORDS]:
                each = [_hashes(t, width, seed) for t in texts]
                lengths, hashes = [len(h) for h in each], np.array([x for h in each for x in h], np.uint64)
                columns += [_majority(hashes, lengths)] if not columns else [_majority(mix(hashes ^ np.uint64(k)), lengths) for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
            prints.append(np.stack(columns, axis=1))
        made = np.concatenate(prints)
        rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        columns = [pa.array(np.ascontiguousarray(made[:, k]).view(np.int64)) for k in range(made.shape[1])]
        names = [batch.schema.names[i] for i in rest] + rule.columns
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *columns, pa.array(rule.nodes(made))], [*names, "node"])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: tuple[str, ...] = ("doc_id",), rule: Rule = STRICT) -> DataFrame:
    """docs(key..., text) -> (key..., fp long, more of the rule's columns, node long)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"{c} long" for c in rule.columns), "node long"])
    return with_batch_rows(docs).select(*key, "text").mapInArrow(partial(_fingerprint, words=words, seed=seed, rule=rule), schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65))
    for batch in batches:
        bits = np.hstack([_bits(batch.column("fp").to_numpy(zero_copy_only=False)), np.ones((batch.num_rows, 1), np.uint8)]).astype(np.float32)
        total += (bits.T @ bits).astype(float)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], ["cell", "n"])


def deal_bits(counts: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Parts of equal width; each takes the bits that correlate most with those it has. counts: 65 x 65, how often bits are
    set together; row 64 holds how often each is set, its last cell the number of fingerprints."""
    n = max(counts[64, 64], 1.0)
    p = counts[64, :64] / n
    cov = counts[:64, :64] / n - np.outer(p, p)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(std, std))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for _ in range(parts):
        part = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(axis=1))))]
        while len(part) < 64 // parts:
            part.append(left.pop(int(np.argmax(corr[np.ix_(left, part)].sum(axis=1)))))
        out.append(sorted(part))
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def _met(histogram: np.ndarray, within: int) -> np.ndarray:
    """How many prints are sent to each value if each goes to all values within so many bits."""
    at, width = np.arange(len(histogram)), len(histogram).bit_length() - 1
    return sum(histogram[at ^ sum(1 << b for b in c)] for k in range(within + 1) for c in combinations(range(width), k))


#: Thresholds beyond this would be probed by too many values.
THRESHOLD_MOST = 4


def allocate(histograms: list[np.ndarray], radius: int = RADIUS) -> list[int]:
    """The thresholds of the parts, least in estimated cost: compared pairs and sent rows.

    histograms: of each part, how many distinct fingerprints have each value (2**width counts)."""
    parts = len(histograms)
    costs = []
    for h in histograms:
        cost = {-1: 0.0}
        for t in range(min(radius, THRESHOLD_MOST) + 1):
            if t == 0 or t % 2:
                met = _met(h, (t + 1) // 2).astype(float)
            cost[t] = float((met * met).sum() + 20 * met.sum())
        costs.append(cost)
    best = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in cost.items():
                if s + t not in then or c + more < then[s + t][0]:
                    then[s + t] = (c + more, [*ts, t])
        best = then
    # any sum from there on covers the radius
    return min((found for s, found in best.items() if s >= radius - parts + 1), key=lambda f: f[0])[1]


def _part_values(batches: Iterator[pa.RecordBatch], parts: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = _bits(batch.column("fp").to_numpy(zero_copy_only=False))
        for i, part in enumerate(parts):
            values, n = np.unique(bits[:, part] @ (1 << np.arange(len(part), dtype=np.int64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(n)], ["part", "value", "n"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        then = label.copy()
        np.minimum.at(then, a, least)
        np.minimum.at(then, b, least)
        np.minimum.at(then, label[a], least)
        np.minimum.at(then, label[b], least)
        then = then[then]
        if np.array_equal(then, label):
            return label
        label = then


def _roots_of_group(prints: np.ndarray, rule: Rule, block: int = 512) -> np.ndarray:
    """As _roots, over all pairs of one large group, a block of rows at a time: memory doesn't grow with the group's square."""
    label, big = np.arange(len(prints)), len(prints)
    block = max(1, min(block, (1 << 22) // max(1, big)))
    while True:
        before = label.copy()
        for s in range(0, len(prints), block):
            near = rule.near(prints[s : s + block, None], prints[None])
            least = np.where(near, label[None, :], big).min(axis=1)
            label = np.minimum(label, np.where(near, least[:, None], big).min(axis=0))
            label = label[label]
        if np.array_equal(before, label):
            return label


def _link_runs(mask: np.ndarray, value: np.ndarray, prints: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the nodes that share mask and value and are linked by the rule. Rows: sorted by both."""
    n = len(prints)
    begins = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
    ends = np.append(begins[1:], n)
    out_a, out_b = [], []
    for s, e in zip(begins[ends - begins > 256], ends[ends - begins > 256]):
        out_a.append(np.arange(s, e))
        out_b.append(_roots_of_group(prints[s:e], rule) + s)
    small = np.repeat(ends - begins <= 256, ends - begins)
    left = np.repeat(ends, ends - begins)
    rows, step, a, b = np.flatnonzero(small), 1, [], []
    while len(rows := rows[rows + step < left[rows]]):
        # the first column decides nearly always
        close = rows[np.bitwise_count(prints[rows, 0] ^ prints[rows + step, 0]) <= rule.radius]
        near = close[rule.near(prints[close], prints[close + step])]
        a.append(near)
        b.append(near + step)
        step += 1
    if a and len(first := np.concatenate(a)):
        root = _roots(n, first, np.concatenate(b))
        moved = np.flatnonzero(root != np.arange(n))
        out_a.append(moved)
        out_b.append(root[moved])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    a, b = a[a != b], b[a != b]
    return rule.nodes(prints[a]), rule.nodes(prints[b])


def _link(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, value); the last, maybe unfinished, group of a batch waits for the next."""
    held = None

    def out(mask, value, *columns):
        prints = np.stack(columns, axis=1).view(np.uint64)
        a, b = _link_runs(mask, value, prints, rule)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", *rule.columns)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        k = int(last[-1]) + 1 if len(last) else 0
        held = [x[k:] for x in now]
        if k:
            yield out(*(x[:k] for x in now))
    if held is not None and len(held[0]):
        yield out(*held)


def _divide(rows: DataFrame, masks: list[int], rule: Rule) -> tuple[DataFrame, list[int]]:
    """Rows of too large groups, sent on to radius + 1 blocks of the bits that their mask leaves free. The table of blocks has
    at most MASKS_MOST rows."""
    parts = rule.radius + 1
    blocks = []
    for m in masks:
        free = [i for i in range(64) if not (m >> i) & 1]
        cuts = [len(free) * k // parts for k in range(parts + 1)]
        blocks += [(m, _mask(free[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
    table = rows.sparkSession.createDataFrame(blocks, "mask long, block long")
    out = rows.join(F.broadcast(table), "mask").select(
        F.col("mask").bitwiseOR(F.col("block")).alias("mask"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("block"))).alias("value"), *rule.columns
    )
    return out, sorted({m | b for m, b in blocks})


def link(prints: DataFrame, rule: Rule = STRICT, most: int = GROUP_MOST) -> DataFrame:
    """prints (the rule's columns), distinct -> links (a, b) of nodes that connect just those that chains of the rule connect."""
    counts = np.zeros(65 * 65)
    for r in prints.mapInArrow(_together, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4,225 rows
        counts[r["cell"]] = r["n"]
    parts = deal_bits(counts.reshape(65, 65))
    histograms = [np.zeros(1 << len(p), np.int64) for p in parts]
    # at most parts * 2**16 rows, however many fingerprints
    for r in prints.mapInArrow(partial(_part_values, parts=parts), "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).collect():
        histograms[r["part"]][r["value"]] = r["n"]
    ways = [(t + 1) // 2 if t >= 0 else -1 for t in allocate(histograms, rule.radius)]
    probes = [(_mask(p), f) for p, k in zip(parts, ways) for f in _flips(p, k)]
    sent = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(f).cast("bigint").alias("f")) for m, f in probes]))
    rows = prints.select(*rule.columns, sent.alias("p")).select(F.col("p.m").alias("mask"), F.col("fp").bitwiseAND(F.col("p.m")).bitwiseXOR(F.col("p.f")).alias("value"), *rule.columns)
    masks, edges = sorted({m for m, _ in probes}), None
    # how many rows meet at a value follows from the histograms
    largest = max(int(_met(h, k).max()) for h, k in zip(histograms, ways) if k >= 0)
    while True:
        fit, rest = rows, None
        if largest > most and len(masks) * (rule.radius + 1) <= MASKS_MOST:
            # written once a level, so that the next ones read them and don't begin anew
            large = cut(rows.groupBy("mask", "value").count().where(F.col("count") > most).select("mask", "value"), "large")
            if not large.isEmpty():
                fit, rest = rows.join(large, ["mask", "value"], "left_anti"), cut(rows.join(large, ["mask", "value"], "left_semi"), "rest")
        got = fit.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(partial(_link, rule=rule), "a long, b long")
        edges = got if edges is None else edges.union(got)
        masks = [m for m in masks if m != -1]
        if rest is None or not masks:
            return edges
        rows, masks = _divide(rest, masks, rule)


_FLIPS, _TIMES = (mix(np.arange(1 + k, 1 + k + 2 * BANDS * ROWS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1))
_TIMES |= np.uint64(1)


@dataclass(frozen=True)
class Sketched(Rule):
    """Candidates: s0 and s1 within `limit` bits together. Columns: node, s0, s1."""

    radius: int = 64
    limit: int | None = SKETCH_LIMIT

    @property
    def columns(self) -> list[str]:
        return ["node", "s0", "s1"]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[..., 1] ^ b[..., 1]) + np.bitwise_count(a[..., 2] ^ b[..., 2]) <= self.limit

    def nodes(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints[:, 0]).view(np.int64)


def _minima(hashes: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of hashes: the keys of its bands, and two numbers of one bit of each minimum. Runs are not empty."""
    begins = np.cumsum(lengths) - np.array(lengths, np.int64)
    least = np.stack([np.minimum.reduceat((hashes ^ x) * m, begins) for x, m in zip(_FLIPS, _TIMES)])
    bands = np.zeros((BANDS, len(lengths)), np.uint64)
    for k in range(ROWS):
        bands = mix(bands * np.uint64(0x100000001B3) + least[k::ROWS])
    bits = np.zeros((128, len(lengths)), np.uint8)
    bits[: len(least)] = mix(least) & np.uint64(1)
    return bands.T, np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def _lowered(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    data, offsets = utf8(batch.column("text"))
    for a, b in spans(offsets, CHUNK_BYTES // 2):
        low = LOWER[data[offsets[a] : offsets[b]]].tobytes()
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        yield [low[s:e] for s, e in zip(at, at[1:])]


def _sketch(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, bands = [np.zeros((0, 4), np.uint64)], []
        for texts in _lowered(batch):
            each = [_hashes(t, words, seed) for t in texts]
            fp = _majority(np.array([x for h in each for x in h], np.uint64), [len(h) for h in each])
            sets = [np.unique(np.array(_hashes(t, NEAR_WORDS, seed), np.uint64)) for t in texts]
            of = [i for i, x in enumerate(sets) if len(x)]
            part, keys = np.zeros((len(texts), 4), np.uint64), [[]] * len(texts)
            part[:, 0], part[:, 1] = fp, [mix(x).sum(dtype=np.uint64) for x in sets]
            if of:
                found, part[of, 2:] = _minima(np.concatenate([sets[i] for i in of]), [len(sets[i]) for i in of])
                for i, k in zip(of, np.ascontiguousarray(found).view(np.int64).tolist()):
                    keys[i] = k
            made.append(part)
            bands += keys
        prints = np.concatenate(made)
        # texts of one fingerprint and one set of shingles are one node
        node = mix(mix(prints[:, 0]) * np.uint64(0x9E3779B97F4A7C15) ^ prints[:, 1])
        columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (prints[:, 0], prints[:, 2], prints[:, 3], node)]
        rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *columns, pa.array(bands, pa.list_(pa.int64()))], [*(batch.schema.names[i] for i in rest), "fp", "s0", "s1", "node", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.array(_hashes(t, NEAR_WORDS, seed), np.uint64)).view(np.int64) for texts in _lowered(batch) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "shingles"])


def _compare(table: pa.Table, similarity: float) -> pa.Table:
    """Spanning links (a, b) of a block: each row that is `open` is compared with all others by the shingle sets."""
    table = table.combine_chunks()
    nodes, open_ = (table.column(c).to_numpy() for c in ("node", "open"))
    sets = [np.asarray(x) for x in table.column("shingles").to_numpy()]
    sizes = np.array([len(x) for x in sets])
    begins, (known, flat) = np.cumsum(sizes) - sizes, np.unique(np.concatenate(sets), return_inverse=True)
    a, b, mark = [], [], np.zeros(len(known), bool)
    for i in np.flatnonzero(open_):
        own = flat[begins[i] : begins[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[flat], begins, dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(common / (sizes + sizes[i] - common) >= similarity)
        a.append(np.full(len(near), i))
        b.append(near)
    root = _roots(len(nodes), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(nodes))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})


def _blocks(n: str):
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _block(n: str):
    return F.pmod(F.xxhash64("node"), _blocks(n)).cast("int")


def _upto(n: str):
    return F.sequence(F.lit(0), _blocks(n) - 1)


def verified_links(sets: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """sets(node, root, shingles) of the members of candidate components, each root being a member -> links (a, b) that connect
    just those that chains of pairs of so similar sets connect."""
    sets = sets.join(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    heads = sets.where("node = root").select("root", F.col("shingles").alias("head"), F.explode(_upto("n")).alias("block"))
    met = sets.where("node <> root").withColumn("block", _block("n")).join(heads, ["root", "block"])
    common = F.size(F.array_intersect("shingles", "head"))
    met = cut(met.select("root", "node", "n", "shingles", (common / (F.size("shingles") + F.size("head") - common) >= similarity).alias("linked")), "met")
    links = met.where("linked").select(F.col("node").alias("a"), F.col("root").alias("b"))
    left = met.where("not linked").groupBy("root").agg(F.count(F.lit(1)).alias("n_open"))
    if left.isEmpty():
        return links
    rows = met.join(left, "root").withColumn("n_done", F.col("n") - 1 - F.col("n_open"))
    one, two = F.lit(0).alias("kind"), F.lit(1).alias("kind")
    fields = ["root", "node", "shingles"]
    own = rows.where("not linked").withColumn("own", _block("n_open"))
    keyed = own.select(*fields, F.lit(True).alias("open"), two, "own", F.explode(_upto("n_open")).alias("k"))
    keyed = keyed.select(*fields, "open", "kind", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    keyed = keyed.union(own.where("n_done > 0").select(*fields, F.lit(True).alias("open"), one, F.explode(_upto("n_done")).alias("i"), F.col("own").alias("j")))
    keyed = keyed.union(rows.where("linked").select(*fields, F.lit(False).alias("open"), one, _block("n_done").alias("i"), F.explode(_upto("n_open")).alias("j")))
    found = keyed.groupBy("root", "kind", "i", "j").applyInArrow(lambda t: _compare(t, similarity), "a long, b long")
    return links.union(found)


def similar_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, key: tuple[str, ...] = ("doc_id",), similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """As near_duplicates, over what op10 links and texts whose five-word shingle sets are similar to `similarity` or more."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"{c} long" for c in ("fp", "s0", "s1", "node")), "bands array<bigint>"])
    prints = cut(with_batch_rows(docs).select(*key, "text").mapInArrow(partial(_sketch, words=words, seed=seed), schema), "prints")
    first = F.min(_order(key)).alias("least")
    distinct = cut(prints.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("fp", "s0", "s1", "bands")]), "distinct")
    by_fp = cut(distinct.groupBy("fp").agg(F.min("node").alias("node")), "by_fp")
    strict = link(by_fp.select("fp"), STRICT)
    strict = strict.join(by_fp.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    same = distinct.select("fp", F.col("node").alias("a")).join(by_fp, "fp").where("a <> node").select("a", F.col("node").alias("b"))
    banded = distinct.select("node", "s0", "s1", F.posexplode("bands").alias("mask", "value"))
    banded = banded.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "node", "s0", "s1")
    found = components(banded.mapInArrow(partial(_link, rule=Sketched()), "a long, b long"))
    members = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    wanted = members.join(distinct.select("node", *[F.col("least")[k].alias(f"_{i}") for i, k in enumerate(key)]), "node")
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
    sets = with_batch_rows(docs.select(*key, "text").join(wanted, on)).select("node", "root", "text").mapInArrow(partial(_shingle_sets, seed=seed), "node long, root long, shingles array<bigint>")
    # equal rows bring the same text
    sets = cut(sets.dropDuplicates(["node"]), "sets")
    links = strict.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(same).union(verified_links(sets, similarity))
    return _with_reps(prints, distinct, components(links), key)


def _order(key: tuple[str, ...]):
    return F.struct(F.col(key[0]).isNull().alias("last"), *key)


def _with_reps(prints: DataFrame, distinct: DataFrame, roots: DataFrame, key: tuple[str, ...]) -> DataFrame:
    classes = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    reps = classes.groupBy("root").agg(F.min("least").alias("rep"))
    by_node = classes.select("node", "root").join(reps, "root").select("node", F.struct(*[F.col("rep")[k].alias(k) for k in key]).alias("rep"))
    return prints.select(*key, "fp", "node").join(by_node, "node").select(*key, "fp", "rep")


def near_duplicates(docs: DataFrame, rule: Rule = STRICT, words: int = 3, seed: int = 42, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(key..., text) -> (key..., fp long, rep): rep is the struct of the smallest key that is reachable by links.

    The key's first column orders first; null keys come last."""
    prints = cut(fingerprints(docs, words, seed, key, rule), "prints")
    distinct = cut(prints.groupBy(*rule.columns, "node").agg(F.min(_order(key)).alias("least")), "distinct")
    return _with_reps(prints, distinct, components(link(distinct.select(*rule.columns), rule)), key)


def op10_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its component."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep.doc_id").alias("component_id"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the near copies: of each component the row of the smallest doc_id stays, of repeated rows one. Copies are
    what op10 links, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    uid = fresh_name(docs, "uid")
    # maps can't be hashed as they are
    rows = docs.withColumn(uid, F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]))
    kept = similar_duplicates(rows, key=("doc_id", uid)).where((F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))) & (F.col(uid) == F.col("rep")[uid]))
    return rows.join(kept.select(uid).distinct(), uid, "left_semi").dropDuplicates([uid]).select(*[F.col(f"`{c}`") for c in docs.columns])

"""t-SNE of any number of rows: every row is embedded, tasks hold the similarities and the driver the coordinates.

Similarities are those of the reference's method (scikit-learn's default): a row's NEIGHBOURS * perplexity + 1 nearest rows, found
among all rows. In each round tasks sum the attraction along them, each for a block of rows, and the repulsion of all rows by all
rows is a convolution on a grid on the driver, which grows with the rows and the grid, not with the pairs; its forces differ from the sums
over all pairs by some hundredth at most. Where the grid would be too large tasks sum the repulsion over all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: How many perplexities of neighbours a row keeps; numbers that a task holds at once; similarities of a block.
NEIGHBOURS, TILE, LINKS = 3, 1 << 21, 1 << 22
#: The most between two nodes of the grid (the kernel's width is 1), the least number of nodes along it, the most cells, and the
#: most rows far from the others that are kept off the grid.
STEP, NODES, CELLS, FAR = 0.25, 60, 1 << 22, 64


def descend(n: int, dims: int, rounds: int, seed: int, gradient: Callable[[np.ndarray, float], np.ndarray]) -> np.ndarray:
    """Coordinates after the rounds; gradient(y, by what similarities are multiplied)."""
    rng = np.random.RandomState(seed)
    y, step, gain = rng.randn(n, dims) * 1e-4, np.zeros((n, dims)), np.ones((n, dims))
    for t in range(rounds):
        grad = gradient(y, 12 if t < rounds // 4 else 1)
        gain = np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8).clip(0.01)
        step = (0.5 if t < rounds // 4 else 0.8) * step - max(n / 48, 50) * gain * grad
        y = y + step
        y -= y.mean(axis=0)
    return y


def nearest(x: np.ndarray, first: int, last: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their k nearest other rows, squared distances) of tiles of rows; ties by a hash of the pair, so that copies of a
    vector choose one another evenly."""
    norms = (x * x).sum(1)
    size = max(1, TILE // len(x))
    for lo in range(first, last, size):
        rows = np.arange(lo, min(lo + size, last))
        d = norms[rows][:, None] + norms[None] - 2 * x[rows] @ x.T
        # rounding would order copies
        d[d < 1e-12 * norms[rows][:, None]] = 0
        d[np.arange(len(rows)), rows] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1]
        taken = d <= most[:, None]
        for r in np.flatnonzero(taken.sum(1) > k):
            tied = np.flatnonzero(d[r] == most[r])
            a, b = np.minimum(tied, rows[r]).astype(np.uint64), np.maximum(tied, rows[r]).astype(np.uint64)
            h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)
            taken[r, tied[np.argsort(h ^ (h >> np.uint64(31)), kind="stable")[k - int((d[r] < most[r]).sum()) :]]] = False
        near = np.nonzero(taken)[1].reshape(len(rows), k)
        yield rows, near, np.take_along_axis(d, near, axis=1)


def shares(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Of each row of squared distances the weights exp(-beta d) that sum to 1 and have the perplexity."""
    d, goal = d - d.min(axis=1, keepdims=True), np.log(perplexity)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(50):
        w = np.exp(-d * beta[:, None])
        s = w.sum(1)
        h = np.log(s) + beta * (d * w).sum(1) / s
        off = np.abs(h - goal) >= 1e-5
        if not off.any():
            break
        low, high = np.where(off & (h > goal), beta, low), np.where(off & (h <= goal), beta, high)
        beta = np.where(off, np.where(np.isinf(high), beta * 2, (low + high) / 2), beta)
    w = np.exp(-d * beta[:, None])
    return w / w.sum(1, keepdims=True)


def _links(t: int, points, runs: list[int], starts: np.ndarray, k: int, perplexity: float) -> Iterator[tuple]:
    """(block, (rows, others, similarities)) of a run of rows, for both rows of a pair: half the mean of both rows' shares."""
    x = points.value
    for rows, near, d in nearest(x, runs[t], runs[t + 1], k):
        p = (shares(d, perplexity) / (2 * len(x))).ravel()
        i, j = np.repeat(rows, k).astype(np.int32), near.ravel().astype(np.int32)
        i, j, p = np.append(i, j), np.append(j, i), np.append(p, p)
        block = np.searchsorted(starts, i, side="right") - 1
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(len(starts)))
        for b, at in enumerate(np.split(order, edges[1:])):
            if len(at):
                yield b, (i[at], j[at], p[at])


def _block(parts: Iterator[tuple]) -> Iterator[tuple]:
    """(first row, starts of the rows, others, similarities) of a block; all its pieces are in one partition."""
    pieces = [piece for _, piece in parts]
    if pieces:
        i, j, p = (np.concatenate(c) for c in zip(*pieces, strict=True))
        order = np.lexsort((j, i))
        i, j, p = i[order], j[order], p[order]
        new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        i, j, p = i[new], j[new], np.add.reduceat(p, new)
        # every row has neighbours, so none is missing between the first and the last
        yield int(i[0]), np.flatnonzero(np.append(True, i[1:] != i[:-1])), j, p


def push(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The repulsion of some rows by all rows, and the sum of their kernels to other rows, over all pairs."""
    out, total, size = np.zeros(rows.shape), 0.0, max(1, TILE // len(y))
    for lo in range(0, len(rows), size):
        a = rows[lo : lo + size]
        q = 1 / (1 + np.maximum((a * a).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * a @ y.T, 0))
        total += q.sum() - len(a)
        q *= q
        out[lo : lo + size] = q.sum(1)[:, None] * a - q @ y
    return out, total


def _forces(blocks: Iterator[tuple], state, whole: bool) -> Iterator[tuple]:
    """(first row, attraction, repulsion and its sum if all pairs are asked for) of each block."""
    y = state.value
    for first, starts, others, p in blocks:
        counts = np.diff(np.append(starts, len(p)))
        diff = [np.repeat(c[first : first + len(starts)], counts) - c[others] for c in y]
        w = p / (1 + sum(d * d for d in diff))
        pull = np.stack([np.add.reduceat(w * d, starts) for d in diff], axis=1)
        yield first, pull, push(y.T[first : first + len(starts)], y.T) if whole else None


def far(y: np.ndarray) -> np.ndarray:
    """Which rows are far from the others: beyond one and a half times the distance from the middle that all but FAR rows keep."""
    off = np.abs(y - np.median(y, axis=0)).max(axis=1)
    return off > 1.5 * np.partition(off, max(0, len(y) - 1 - FAR))[max(0, len(y) - 1 - FAR)]


class Grid:
    """The repulsion of all rows by all rows: rows are dealt to the nodes around them by cubic weights, nodes repel each other by a
    convolution, and rows take the repulsion of the nodes around them. The pairs of rows far from the others are summed one by one."""

    def __init__(self) -> None:
        self.key, self.kernels = None, None

    @staticmethod
    def size(y: np.ndarray) -> tuple[float, int]:
        """(distance of nodes, cells along a side of the convolution)."""
        span = float(np.ptp(y, axis=0).max())
        step = min(STEP, span / NODES) or STEP
        # twice the nodes, up to a product of small primes
        return step, min(f << e for f in (9, 15, 25, 27) for e in range(64) if f << e >= 2 * (int(span / step) + 5) - 1)

    @classmethod
    def fits(cls, y: np.ndarray) -> bool:
        return bool(np.isfinite(y).all()) and cls.size(y[~far(y)])[1] ** y.shape[1] <= CELLS

    def _transforms(self, step: float, cells: int, dims: int) -> list[np.ndarray]:
        if self.key != (step, cells, dims):
            lag = np.fft.fftfreq(cells, 1 / cells) * step
            lags = np.meshgrid(*[lag] * dims, indexing="ij", sparse=True)
            q = 1 / (1 + sum(c * c for c in lags))
            self.key, self.kernels = (step, cells, dims), [np.fft.rfftn(k) for k in (q, *[c * q * q for c in lags])]
        return self.kernels

    def _near(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        dims = y.shape[1]
        step, cells = self.size(y)
        u = (y - y.min(axis=0)) / step + 1
        base = np.floor(u).astype(np.int64)
        f = u - base
        weights = [-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6]
        around = [
            (np.ravel_multi_index(tuple(base[:, c] + o - 1 for c, o in enumerate(corner)), (cells,) * dims), np.prod([weights[o][:, c] for c, o in enumerate(corner)], axis=0))
            for corner in np.ndindex(*[4] * dims)
        ]
        charge = np.zeros(cells**dims)
        for at, w in around:
            charge += np.bincount(at, w, minlength=len(charge))
        charge = charge.reshape((cells,) * dims)
        spread = np.fft.rfftn(charge)
        fields = [np.fft.irfftn(spread * k, charge.shape, axes=range(dims)).ravel() for k in self._transforms(step, cells, dims)]
        return np.stack([sum(w * field[at] for at, w in around) for field in fields[1:]], axis=1), float(charge.ravel() @ fields[0]) - len(y)

    def push(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """As push() of all rows."""
        alone, out = far(y), np.zeros(y.shape)
        near, off = np.flatnonzero(~alone), np.flatnonzero(alone)
        out[near], total = self._near(y[near])
        for i in off:
            diff = y - y[i]
            q = 1 / (1 + (diff * diff).sum(1))
            pushed = (q * q)[:, None] * diff
            out[near] += pushed[near]
            out[i] = -pushed.sum(0)
            # pairs with a row on the grid count from both sides
            total += q.sum() - 1 + q[near].sum()
        return out, total


def embed(rows: DataFrame, dims: int, perplexity: float, rounds: int, seed: int) -> DataFrame:
    """(id, v) of all rows(id, v)."""
    spark = rows.sparkSession
    sc, table = spark.sparkContext, rows.select("id", "v").toArrow().sort_by("id")
    x = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(table), -1)
    ids, n = table["id"], len(table)
    del table
    k = min(n - 1, int(NEIGHBOURS * perplexity + 1))
    count = max(1, min(n, max(sc.defaultParallelism, -(-2 * n * k // LINKS))))
    starts = np.arange(count) * n // count
    tasks = min(n, 4 * count)
    runs = [n * t // tasks for t in range(tasks + 1)]
    points = sc.broadcast(x - x.mean(axis=0))
    del x
    links = partial(_links, points=points, runs=runs, starts=starts, k=k, perplexity=min(perplexity, n - 1))
    blocks = sc.parallelize(range(tasks), tasks).flatMap(links).partitionBy(count, int).mapPartitions(_block).persist(StorageLevel.MEMORY_AND_DISK)
    grid = Grid()
    try:
        with ThreadPoolExecutor(1) as aside:

            def gradient(y: np.ndarray, more: float) -> np.ndarray:
                whole = not grid.fits(y)
                state = sc.broadcast(np.ascontiguousarray(y.T))
                pushed = None if whole else aside.submit(grid.push, y)
                # the session may have dealt to more partitions than there are blocks
                parts = sorted(sc.runJob(blocks, partial(_forces, state=state, whole=whole), range(count)), key=lambda p: p[0])
                state.destroy()
                away, total = (np.concatenate([p[2][0] for p in parts]), sum(p[2][1] for p in parts)) if whole else pushed.result()
                return 4 * (more * np.concatenate([p[1] for p in parts]) - away / total)

            y = descend(n, dims, rounds, seed, gradient)
    finally:
        blocks.unpersist()
        points.destroy()
    v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(y.ravel()))
    return spark.createDataFrame(pa.table({"id": ids, "v": v}), f"id {dict(rows.dtypes)['id']}, v array<double>")

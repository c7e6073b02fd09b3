"""Dimension reduction: standardizing, principal components, random projection, t-SNE.

rows(id, v array<double>). Moments are summed in the map tasks (a matrix of d x d numbers per task, by cells to one result), the
decomposition of that matrix is done on the driver, and rows are transformed where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tsne import descend
from .tsne import embed as embed_all


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=float) if len(col) else np.zeros((0, 0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = _matrix(batch.column("v"))
        if len(x):
            x = np.hstack([x, np.ones((len(x), 1))])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "x"])


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population covariance)."""
    cells = rows.select("v").mapInArrow(_moments, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    if not cells:
        raise ValueError("no rows")
    d = int(round(len(cells) ** 0.5)) - 1
    m = np.zeros((d + 1) * (d + 1))
    for c in cells:
        m[c["cell"]] = c["x"]
    m = m.reshape(d + 1, d + 1)
    n = m[d, d]
    mean = m[d, :d] / n
    return int(round(n)), mean, m[:d, :d] / n - np.outer(mean, mean)


def _apply(batches: Iterator[pa.RecordBatch], shift: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("v"))
        y = (x - shift) @ matrix if len(x) else np.zeros((0, matrix.shape[1]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * matrix.shape[1], pa.int32()), pa.array(y.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), out], ["id", "v"])


def linear(rows: DataFrame, shift: np.ndarray, matrix: np.ndarray) -> DataFrame:
    return rows.select("id", "v").mapInArrow(partial(_apply, shift=shift, matrix=matrix), f"id {dict(rows.dtypes)['id']}, v array<double>")


def standardize(rows: DataFrame) -> DataFrame:
    """Every column less its mean, by its population deviation (1 where it is constant)."""
    _, mean, cov = moments(rows)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    return linear(rows, mean, np.diag(1 / np.where(std < 1e-12, 1, std)))


def varying_columns(rows: DataFrame, least: float = 1e-10, fallback: int = 10) -> list[int]:
    """Columns of more than the least variance; if there is none, the ten of most variance."""
    _, _, cov = moments(rows)
    var = np.diag(cov)
    kept = np.flatnonzero(var > least)
    return [int(k) for k in (kept if len(kept) else np.argsort(-var, kind="stable")[:fallback])]


@dataclass
class PCA:
    """Principal components; fit() first."""

    n_dims: int
    whiten: bool = False
    standardized: bool = True
    shift: np.ndarray | None = None
    matrix: np.ndarray | None = None
    ratios: np.ndarray | None = None

    def fit(self, rows: DataFrame) -> PCA:
        n, mean, cov = moments(rows)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = 1 / np.where(std < 1e-12, 1, std) if self.standardized else np.ones(len(mean))
        values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
        order = np.argsort(-values, kind="stable")[: min(self.n_dims, len(mean), n)]
        vectors = vectors[:, order] * np.where(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] < 0, -1, 1)
        kept = np.maximum(values[order], 0)
        self.ratios = kept / max(float(np.maximum(values, 0).sum()), 1e-300)
        self.shift, self.matrix = mean, scale[:, None] * vectors
        if self.whiten:
            self.matrix = self.matrix / np.sqrt(np.maximum(kept * n / max(n - 1, 1), 1e-12))
        return self

    def _fitted(self) -> None:
        if self.matrix is None:
            raise ValueError("PCA not fitted yet")

    def transform(self, rows: DataFrame) -> DataFrame:
        self._fitted()
        return linear(rows, self.shift, self.matrix)

    def explained(self) -> np.ndarray:
        self._fitted()
        return self.ratios


def components_for(ratios: np.ndarray, share: float = 0.95) -> int:
    """How many first components reach the share; 1 if none do."""
    return int(np.argmax(np.cumsum(ratios) >= share)) + 1


def random_projection(rows: DataFrame, size: int, dim: int, seed: int = 42) -> DataFrame:
    return linear(rows, np.zeros(size), np.random.RandomState(seed).randn(size, dim) / np.sqrt(dim))


#: Rows that one task embeds with all their distances; more are embedded by all tasks.
TSNE_MOST = 5000


def _tsne(x: np.ndarray, dims: int, perplexity: float, rounds: int, seed: int) -> np.ndarray:
    n = len(x)
    if n < 2:
        return np.zeros((n, dims))
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    p, goal = np.zeros((n, n)), np.log(min(perplexity, n - 1))
    for i in range(n):
        low, high, beta, row = 0.0, np.inf, 1.0, np.delete(d[i], i)
        for _ in range(50):
            w = np.exp(-(row - row.min()) * beta)
            s = w.sum()
            h = np.log(s) + beta * float(((row - row.min()) * w).sum()) / s
            if abs(h - goal) < 1e-5:
                break
            low, high = (beta, high) if h > goal else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i, np.arange(n) != i] = w / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)

    def gradient(y: np.ndarray, more: float) -> np.ndarray:
        q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = ((p * more) - q / q.sum()) * q
        return 4 * (w.sum(1)[:, None] * y - w @ y)

    return descend(n, dims, rounds, seed, gradient)


def tsne(rows: DataFrame, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 42) -> DataFrame:
    """(id, v) of all rows: up to TSNE_MOST in one task, more by tsne.embed()."""
    if dims > 3:
        raise ValueError("t-SNE embeds in at most 3 dimensions")
    if rows.count() > TSNE_MOST:
        return embed_all(rows, dims, perplexity, rounds, seed)

    def embed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["v"].tolist(), dtype=float)
        return pd.DataFrame({"id": pdf["id"], "v": list(_tsne(x, dims, min(perplexity, max(1.0, len(x) - 1.0)), rounds, seed))})

    return rows.select("id", "v", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda pdf: embed(pdf[["id", "v"]]), f"id {dict(rows.dtypes)['id']}, v array<double>")


REDUCERS = {"pca": lambda rows, dim, **kw: PCA(dim, **kw).fit(rows).transform(rows), "tsne": lambda rows, dim, **kw: tsne(rows, dim, **kw), "random": lambda rows, dim, **kw: random_projection(rows, kw.pop("size"), dim, **kw)}


def register_reducer(name: str, f) -> None:
    REDUCERS[name] = f


def get_reducer(name: str):
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name}; there are {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name]

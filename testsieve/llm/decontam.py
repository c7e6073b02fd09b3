"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Method. Words are runs of digits, letters and non-ASCII characters, with A-Z and the capitals of Latin-1 lower-cased. An item of L words is compared with
every window of L words of a document (a document of fewer words is one window). Windows that share no shingle with an item
of their size have similarity 0 with all of them, so only windows that hold a shingle of such an item are fingerprinted; that
loses nothing. A window's SimHash is looked up in blocks of bits: fingerprints within RADIUS agree on one of BLOCKS blocks to
within RADIUS // BLOCKS bits, so every item within the radius is found. What is found is verified by the weighted Jaccard
similarity of the shingle counts (weight: log(1 + items / items that have the shingle)), at least SIMILARITY.

Items are held by every task, in blocks of at most ITEM_BYTES of text and ITEMS_MOST items; a larger benchmark takes several passes.
An item takes some 30 bytes for each of its words and 1 KB beside them, and what is looked up at once is bounded by PAIRS. Weights
are those of the whole benchmark in every pass: shingles that two items or more have are counted once over all items, and every
block has their table; all others, of one item or none, have the same weight.

Defined cases: null and empty texts and items without words never match; an item of fewer words than a shingle is one shingle;
repeated rows give repeated result rows; equal items are each reported; an item without an id is matched like any other and
reported with a null id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, WORD_BYTE, fold_case, gather, mix, read_table, spans, utf8, with_batch_rows, word_bounds, word_hashes

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 7
ITEM_BYTES, ITEMS_MOST = 4 << 20, 1 << 15
#: Windows that are fingerprinted at once, and windows times items that are looked up at once.
WINDOWS, PAIRS = 4096, 1 << 20


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, of all words if there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x100000001B3) + words[j : j + n])
    return out


def simhash(weights: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles [start, end) of one sequence, for all given ranges."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    sums = np.zeros((len(hashes) + 1, 64))
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[ends] - sums[starts] > 1e-9, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """Finds all of a set of fingerprints within a radius, by blocks of bits: of each block the items are listed by their value
    (8 bytes an item), and a fingerprint looks up its own value and all within radius // blocks bits of it."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.prints, self.radius, self.blocks = prints, radius, []
        edges = [64 * i // blocks for i in range(blocks + 1)]
        for lo, hi in zip(edges, edges[1:]):
            values = self._block(prints, lo, hi)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1))
            flips = np.array([sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in combinations(range(hi - lo), k)])
            self.blocks.append((lo, hi, order, starts, flips))

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of prints, which item) for all pairs within the radius."""
        most = max(1, PAIRS // max(1, len(self.prints)))
        parts = [self._search(prints[a : a + most]) for a in range(0, len(prints), most)]
        if len(parts) == 1:
            return parts[0]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(q + k * most for k, (q, _) in enumerate(parts))]), np.concatenate([none, *(i for _, i in parts)])

    def _search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros((len(prints), len(self.prints)), bool)
        for lo, hi, order, starts, flips in self.blocks:
            values = self._block(prints, lo, hi)[:, None] ^ flips
            begin = starts[values].ravel()
            n = starts[values + 1].ravel() - begin
            found[np.repeat(np.repeat(np.arange(len(prints)), len(flips)), n), order[gather(begin, n)]] = True
        q, i = np.nonzero(found)
        ok = np.bitwise_count(prints[q] ^ self.prints[i]) <= self.radius
        return q[ok], i[ok]


def _words(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words."""
    data, offsets = utf8(texts)
    data = fold_case(data)
    starts, ends, before = word_bounds(data, offsets, WORD_BYTE)
    return np.split(word_hashes(data, starts, ends), before[1:-1]) if len(texts) else []


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int = SHINGLE, similarity: float = SIMILARITY, counted: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        """counted: how many items there are in all blocks, the shingles (sorted) that several of them have, and how many have each."""
        self.k, self.similarity = k, similarity
        self.ids, self.words, shingles = [], [], []
        for i, words in enumerate(_words(pa.array([t or "" for t in texts], pa.large_string()))):
            if len(words):
                self.ids.append(ids[i])
                self.words.append(len(words))
                shingles.append(shingle_hashes(words, k))
        self.shingles = [np.unique(s, return_counts=True) for s in shingles]
        flat = np.concatenate([s for s, _ in self.shingles]) if shingles else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(shingles)), [len(s) for s, _ in self.shingles])
        order = np.argsort(flat, kind="stable")
        self.known, begin, n = np.unique(flat[order], return_index=True, return_counts=True)
        self.owners, self.owner_at, self.owner_n = owner[order], begin, n
        total, self.weighed, having = counted or (len(shingles), self.known, n)
        self.weight = np.log1p(total / having)
        self.rare = float(np.log1p(total)) if total else 1.0  # of shingles that no item has, or only one
        self.bitmap = np.zeros(1 << max(16, 4 + int(len(self.known)).bit_length()), bool)
        self.bitmap[(self.known & np.uint64(len(self.bitmap) - 1)).astype(np.int64)] = True
        size = np.array(self.words, np.int64)
        self.size = size
        self.by_size = {}
        for n in sorted(set(self.words)):
            of = np.flatnonzero(size == n)
            prints = np.concatenate([simhash(self.weigh(shingles[i]), shingles[i], np.array([0]), np.array([len(shingles[i])])) for i in of])
            self.by_size[n] = (of, MultiIndex(prints))
        self.totals = np.array([float((self.weigh(s) * c).sum()) for s, c in self.shingles])
        #: Shingles of fewer words than k come from items that have no more words.
        self.lengths = sorted({min(k, n) for n in self.words})

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.weighed):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.weighed, hashes), len(self.weighed) - 1)
        return np.where(self.weighed[at] == hashes, self.weight[at], self.rare)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of a known shingle) wherever one stands."""
        at = np.flatnonzero(self.bitmap[(hashes & np.uint64(len(self.bitmap) - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        ok = self.known[number] == hashes[at]
        return at[ok], number[ok]

    def verify(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingle counts of an item and a window."""
        values, counts = self.shingles[item]
        mine, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
        common = float((self.weigh(values) * np.where(mine[at] == values, np.minimum(n[at], counts), 0)).sum())
        total = self.totals[item] + float((self.weigh(mine) * n).sum()) - common
        return common / total if total else 0.0

    def search(self, words: np.ndarray, positions: np.ndarray, numbers: np.ndarray, k: int) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that a document holds.

        positions, numbers: where known shingles of k words stand among its words."""
        best: dict[int, tuple[float, int, int]] = {}
        n = self.owner_n[numbers]
        items, at = self.owners[gather(self.owner_at[numbers], n)], np.repeat(positions, n)
        sizes = self.size[items]
        for size in np.unique(sizes[np.minimum(sizes, self.k) == k]):
            p = np.unique(at[sizes == size])
            long = min(int(size), len(words))
            low, high = np.maximum(p - (long - k), 0), np.minimum(p, len(words) - long)
            fresh = np.maximum(low, np.concatenate([[0], high[:-1] + 1]))
            starts = gather(fresh, np.maximum(high - fresh + 1, 0))
            of, index = self.by_size[int(size)]
            for a in range(0, len(starts), WINDOWS):
                some = starts[a : a + WINDOWS]
                for part in np.split(some, np.flatnonzero(np.diff(some) > 4 * size) + 1):
                    first = int(part[0])
                    hashes = shingle_hashes(words[first : int(part[-1]) + long], k)
                    q, i = index.search(simhash(self.weigh(hashes), hashes, part - first, part - first + long - k + 1))
                    for w, j in zip((part[q] - first).tolist(), of[i].tolist()):
                        s = self.verify(j, hashes[w : w + long - k + 1])
                        if s >= self.similarity - 1e-12 and s > best.get(j, (0.0,))[0] + 1e-12:
                            best[j] = (s, first + w, long)
        return [(self.ids[j], *found) for j, found in sorted(best.items())]


def found_in(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item_id, similarity, first word, words) for all rows of a text column."""
    if not items.ids:
        return
    for a, b in spans(offsets, CHUNK_BYTES):
        part = fold_case(data[offsets[a] : offsets[b]])
        starts, ends, before = word_bounds(part, offsets[a : b + 1] - offsets[a], WORD_BYTE)
        words = word_hashes(part, starts, ends)
        if not len(words):
            continue
        for k in items.lengths:
            if len(words) < k:
                continue
            at, number = items.hits(shingle_hashes(words, k))
            row = np.searchsorted(before, at, side="right") - 1
            inside = at + k <= before[row + 1]
            at, number, row = at[inside], number[inside], row[inside]
            for r in np.unique(row):
                s = row == r
                for found in items.search(words[before[r] : before[r + 1]], at[s] - before[r], number[s], k):
                    yield (a + int(r), *found)


def _item_shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each item's different shingles; `item` is 1 in one row of each item."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(w, k)) for w in _words(batch.column("text")) if len(w)]
        item = [np.arange(len(s)) == 0 for s in sets]
        shingle = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.concatenate([np.zeros(0, bool), *item]).astype(np.int64))], ["shingle", "item"])


def count_shingles(rows: DataFrame, k: int = SHINGLE) -> tuple[int, np.ndarray, np.ndarray]:
    """How many items have words, the shingles that two or more of them have, and how many have each."""
    counts = with_batch_rows(rows).select("text").mapInArrow(partial(_item_shingles, k=k), "shingle long, item long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("items"))
    total = counts.agg(F.sum("items")).first()[0] or 0
    several = counts.where("n > 1").select("shingle", "n").toArrow()
    shingles, n = several.column("shingle").to_numpy().view(np.uint64), several.column("n").to_numpy()
    order = np.argsort(shingles)
    return int(total), shingles[order], n[order]


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES, items_most: int = ITEMS_MOST) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, for one pass over the documents each."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    counted, rows = count_shingles(rows), rows.orderBy("item_id", "text")
    ids, texts, held = [], [], 0
    for r in rows.toLocalIterator():
        if held and (held + len(r["text"]) > most or len(ids) >= items_most):
            yield Items(ids, texts, counted=counted)
            ids, texts, held = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
    yield Items(ids, texts, counted=counted)


def _matches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(found_in(*utf8(batch.column("text")), items))
        row, item, sim, first, n = zip(*found) if found else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
            ["doc_id", "item_id", "similarity", "first_word", "n_words"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, similarity, first_word, n_words), the best window of
    every item that a document holds."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, similarity double, first_word long, n_words long"
    passes = [with_batch_rows(docs).select("doc_id", "text").mapInArrow(partial(_matches, items=items), schema) for items in item_blocks(benchmark)]
    return reduce(DataFrame.union, passes)


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the items."""
    return contaminated(read_table(spark, sf_dir, "documents", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _clean(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        keep[[f[0] for f in found_in(*utf8(batch.column("text")), items)]] = False
        yield batch.filter(pa.array(keep))


def decontam_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item; no row moves between tasks."""
    for items in item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = with_batch_rows(docs).mapInArrow(partial(_clean, items=items), docs.schema)
    return docs

"""Improbable-feature digests: byte windows ranked by entropy-based rarity, in chained Bloom filters.

Method. Every window of WINDOW bytes has an entropy, kept exactly by integer updates as the window slides. Its rarity rank
comes from that entropy: the fewer windows of ordinary text have it (SHARES, measured), the better; windows of little entropy
(repeats, padding) rank last. In every run of RUN windows the one of the best rank gets a point (ties: the least hash, then the
first); runs reach over both ends of a text, so that its first and last windows are in as many as others. Windows of at least
POINTS points are the features; a text of fewer bytes than a window is one window. So one rule holds for texts of every size and
kind, and each that isn't empty has a feature. A feature's hash sets HASHES bits of the text's last Bloom filter of FILTER_BITS
bits; a filter takes FILTER_MOST features, then the next one is chained. Likeness compares each filter of the shorter digest with
its best match in the longer one: the bits that both have, less what two filters of these weights share by chance, divided by
the most that they could share; averaged, 0 to 1.

Equal texts give equal digests. Null and empty texts have the empty digest; it is like itself (1), and unlike any other (0).

op2: documents are dealt into runs of neighbouring doc_id by quantiles of the ids; the first row of each run also goes to the
run before, so each text is moved once (compressed) and the next one is at hand. Ties of doc_id are ordered by the text's hash;
null doc_id comes last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, gather, mix, read_table, spans, with_batch_rows

WINDOW, RUN, POINTS = 8, 32, 3
FILTER_BITS, FILTER_MOST, HASHES = 2048, 160, 5
#: Documents of a run of neighbours at least, and runs at most (the driver holds a bound and an id of each; longer runs are
#: streamed, so their length costs no memory).
RUN_DOCS, RUNS_MOST = 2000, 20_000
#: Bytes that the kernels take at once.
PIECE = 1 << 19

_ONE = 1 << 40
_C = np.arange(WINDOW + 1)
#: -c/W log2(c/W) of a byte that stands c times in a window, in integers.
_TERM = np.where(_C > 0, np.rint(-(_C / WINDOW) * np.log2(np.maximum(_C, 1) / WINDOW) * _ONE), 0).astype(np.int64)
#: What the entropy gains when a byte that stood c times enters, and loses when one that stands c more times leaves.
_GAIN = np.append(_TERM[1:] - _TERM[:-1], 0)

#: Fixed values, measured over the documents of sf0.1: of a million windows of 8 bytes, how many have each entropy (in 1/64 bits).
SHARES = {
    0: 0, 34: 0, 51: 1, 61: 1, 64: 150, 67: 16, 83: 25, 89: 555, 96: 112, 99: 3862, 112: 3142, 115: 3585, 121: 13702, 128: 9024, 137: 67342, 144: 64667, 153: 65999,
    160: 263432, 176: 360973, 192: 143412,
}
#: Windows under so many 64ths of a bit, of three different bytes at most, rank last.
LOW = 96


def rank_table(shares: dict[int, int], low: int = LOW) -> np.ndarray:
    """The rank of each entropy (in 1/64 bits): 0 is the rarest."""
    order = sorted(shares, key=lambda h: (h < low, shares[h], h))
    table = np.zeros(64 * 3 + 1, np.uint64)
    for rank, h in enumerate(order):
        table[h] = rank
    return table


_RANK = rank_table(SHARES)


def window_entropy(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of WINDOW bytes, scaled by 2**40. Exact: the same window has the same value anywhere."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    n = len(data) - WINDOW + 1
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)  # equal bytes among the others of a window before and after
    for k in range(1, WINDOW):
        same = (data[:-k] == data[k:]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    step = _GAIN[before[WINDOW:]] - _GAIN[after[: n - 1]]
    counts = np.bincount(data[:WINDOW])
    out = np.empty(n, np.int64)
    out[0] = _TERM[counts].sum()
    np.cumsum(step, out=out[1:])
    out[1:] += out[0]
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the features of all rows, by place, from PIECE bytes at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in spans(offsets, PIECE):
        at, end = int(offsets[a]), int(offsets[b])
        if end - at <= PIECE:
            row, _, hashes = _chosen(data[at:end], offsets[a : b + 1] - at)
            found.append((row + a, hashes))
            continue
        # a window's points depend on the RUN - 1 windows before and after it
        for lo in range(at, end - WINDOW + 1, PIECE):
            first, last = max(at, lo - RUN + 1), min(end, lo + PIECE + RUN - 1 + WINDOW - 1)
            _, place, hashes = _chosen(data[first:last], np.array([0, last - first]))
            own = (place + first >= lo) & (place + first < lo + PIECE)
            found.append((np.full(int(own.sum()), a), hashes[own]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _chosen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, hash) of the features."""
    lens = np.diff(offsets)
    rows = np.flatnonzero(lens)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = np.maximum(1, lens[rows] - WINDOW + 1)
    starts = gather(offsets[rows], n)
    ends = np.minimum(starts + WINDOW, np.repeat(offsets[rows + 1], n))
    hashes = mix(((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))
    # the only window of a row of fewer bytes has any rank
    index = np.zeros(len(data), np.int64)
    entropy = (window_entropy(data) + (1 << 10)) >> 34  # what was rounded, rounded up
    index[: len(entropy)] = entropy
    key = (_RANK[index[starts]] << np.uint64(56)) | ((hashes >> np.uint64(40)) << np.uint64(32)) | np.arange(len(starts), dtype=np.uint64)
    # rows lie RUN - 1 empty places apart, so that no run meets two of them
    best = np.full(len(starts) + (RUN - 1) * (len(rows) + 1), _NONE)
    best[np.arange(len(starts)) + np.repeat((RUN - 1) * np.arange(1, len(rows) + 1), n)] = key
    width = 1
    while width < RUN:
        step = min(width, RUN - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    place, points = np.unique(best[best != _NONE] & np.uint64(0xFFFFFFFF), return_counts=True)
    place = place[points >= POINTS].astype(np.int64)
    return np.repeat(rows, n)[place], starts[place], hashes[place]


_NONE = np.uint64((1 << 64) - 1)


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text its filters, (filters, FILTER_BITS / 8) bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, hashes = _features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    counts = np.bincount(row, minlength=len(texts))
    filters = -(-counts // FILTER_MOST)
    first = np.cumsum(filters) - filters
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[row] + number // FILTER_MOST
    bits = np.zeros((int(filters.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        bits[at, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1, bitorder="little")
    return [packed[a : a + n] for a, n in zip(first, filters)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, n in zip(x, nx):
        both = np.bitwise_count(y & row).sum(axis=1, dtype=np.int64)
        chance, most = n * ny / FILTER_BITS, np.minimum(n, ny)
        total += float(np.max(np.clip((both - chance) / np.maximum(most - chance, 1), 0, 1)))
    return total / len(x)


def text_of(filters: np.ndarray) -> str:
    """The digest as a string: the filters in hexadecimal, joined by dots."""
    return ".".join(f.tobytes().hex() for f in filters)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
    """rows: neighbours in order with whether they belong here; each but the last is compared with the one after it."""
    texts = [t for _, t, _ in rows]
    other = [edited(a, b) for a, b in zip(texts, texts[1:])]
    made = digests([t.encode() for t in texts] + [t.encode() for t in other])
    own, changed = made[: len(texts)], made[len(texts) :]
    out = [
        (d, len(t), hashlib.sha256(o.encode()).hexdigest(), text_of(f), text_of(g), likeness(f, g), likeness(f, h))
        for (d, t, mine), o, f, g, h in zip(rows, other, own, changed, own[1:])
        if mine
    ]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 7, _KINDS)], _NAMES)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _neighbours(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of (run, ..., z, mine) in order of run and place; a run's last row that isn't its own only serves as the next."""
    unpack = zstandard.ZstdDecompressor()
    held: list[tuple] = []
    run, size = None, 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("run", "doc_id", "z", "mine")]
        for r, d, z, mine in zip(*cols):
            if r != run:
                if len(held) > 1:
                    yield _compared(held)
                held, run, size = [], r, 0
            held.append((d, unpack.decompress(z).decode() if z else "", mine))
            size += len(held[-1][1])
            if size > most and len(held) > 1:
                yield _compared(held)
                held, size = held[-1:], 0
    if len(held) > 1:
        yield _compared(held)


def _dealt(batches: Iterator[pa.RecordBatch], bounds: list[int], heads: dict, last: int) -> Iterator[pa.RecordBatch]:
    """Each row to its run, and the first row of a run also to the run before it (of the first run: to the last)."""
    pack = zstandard.ZstdCompressor(level=1)
    edges = np.array(bounds, np.int64)
    for batch in batches:
        out = []
        for d, t, tie in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tie"))):
            run = last if d is None else len(edges) - int(np.searchsorted(edges, d, side="right"))
            raw = (t or "").encode()
            z = pack.compress(raw) if raw else b""
            place = -(d if d is not None else -(1 << 63)) if d != -(1 << 63) else (1 << 63) - 1
            place = min(place, (1 << 63) - 1)
            out.append((run, False, place, tie, d, z, True))
            if (before := heads.get((d, tie))) is not None:
                out.append((before, True, 0, 0, d, z, False))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], ["run", "late", "place", "tie", "doc_id", "z", "mine"])


def neighbour_digests(docs: DataFrame, run_docs: int = RUN_DOCS) -> DataFrame:
    """docs(doc_id, text), doc_id descending, each with the next one (after the last the first) -> the columns of _SCHEMA.

    The driver holds one bound and one id per run of run_docs documents."""
    rows = with_batch_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id")
    total = ids.count()
    runs = min(RUNS_MOST, max(1, total // run_docs))
    bounds = []
    if runs > 1:
        shares = [i / runs for i in range(1, runs)]
        bounds = sorted(set(ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", shares, 10 * runs)).first()[0] or []))
    return _digest_runs(rows, bounds)


def _digest_runs(rows: DataFrame, bounds: list[int]) -> DataFrame:
    last = len(bounds)
    keyed = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    # the head of each run: its largest id; ties by the smallest hash. Text is read only for the hash, nothing is moved.
    heads = _heads(keyed, bounds)
    present = sorted(heads)
    before = {heads[r]: present[i - 1] if i else present[-1] for i, r in enumerate(present)}
    dealt = keyed.mapInArrow(partial(_dealt, bounds=bounds, heads=before, last=last), "run long, late boolean, place long, tie long, doc_id long, z binary, mine boolean")
    runs = last + 1
    tasks = min(runs, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("run") * tasks / runs).cast("int")).sortWithinPartitions("run", "late", "place", "tie")
    return dealt.mapInArrow(_neighbours, _SCHEMA)


def _heads_of(batches: Iterator[pa.RecordBatch], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """Of each run the first row's (doc_id, tie) among a task's rows."""
    edges, best = np.array(bounds, np.int64), {}
    for batch in batches:
        for d, tie in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()):
            run = len(edges) if d is None else len(edges) - int(np.searchsorted(edges, d, side="right"))
            key = (d is None, -(d or 0), tie)
            if run not in best or key < best[run]:
                best[run] = key
    rows = [(r, None if k[0] else -k[1], k[2]) for r, k in best.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["run", "doc_id", "tie"])


def _heads(keyed: DataFrame, bounds: list[int]) -> dict[int, tuple[int | None, int]]:
    found = keyed.select("doc_id", "tie").mapInArrow(partial(_heads_of, bounds=bounds), "run long, doc_id long, tie long")
    order = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "tie")
    return {r["run"]: (r["doc_id"], r["tie"]) for r in found.groupBy("run").agg(F.min_by(F.struct("doc_id", "tie"), order).alias("h")).select("run", "h.*").collect()}


def op2_rare_digest(spark, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and their likeness."""
    return neighbour_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))

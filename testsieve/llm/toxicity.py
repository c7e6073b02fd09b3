"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Method. Words are runs of digits, letters and non-ASCII characters in lower case. A word's input is a hashed word embedding
beside the mean of the hashed embeddings of its byte 3- and 4-grams, ends marked. A text is read in windows of WINDOW words
that overlap by half, the last one ending with the text. Two gated recurrent layers, one per direction, read each window;
attention weights pool their states into the window's logit. A text's logit is that of its highest window, and a logistic
calibration, fitted to texts that the training doesn't see, turns it into the score.

Training: texts are bags of windows (log-mean-exp pooling, so the gradient goes to the windows that look toxic), Adam, at most
POSITIVES and NEGATIVES labelled rows of at most SAMPLE_CHARS code points, drawn by a hash. Scoring reads whole texts.

A word's input, times the layers' input weights, is computed once per distinct word of a chunk; a window step is then a lookup,
one small matrix product and the gates, for thousands of windows at once.

Defined cases: null, empty and wordless texts score 0; without labelled rows of both kinds every text scores 0; null labels
don't train; several labels of one doc_id count as toxic if one does; repeated rows give repeated result rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, WORD_BYTE, fold_case, gather, read_table, spans, utf8, with_batch_rows, word_bounds, word_hashes

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, WORD_BUCKETS, CHAR_BUCKETS = 8, 8, 12, 1 << 12, 1 << 13
POSITIVES, NEGATIVES, SAMPLE_CHARS = 900, 1500, 3000
EPOCHS, BATCH_TEXTS, RATE, SEED = 5, 24, 0.015, 11
#: A draw is a number below DRAWS.
DRAWS = 1 << 62
#: Windows that are read at once.
WINDOWS = 2048


def char_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the 3- and 4-grams of the given words, one after the other, and how many each word has."""
    lens = ends - starts + 2
    flat = np.zeros(int(lens.sum()), np.uint32)
    at = np.cumsum(lens) - lens
    inner = gather(at + 1, ends - starts)
    flat[inner] = data[gather(starts, ends - starts)]
    flat[at], flat[at + lens - 1] = 1, 2
    codes, owners = [], []
    word = np.repeat(np.arange(len(lens)), lens)
    for n in (3, 4):
        if len(flat) < n:
            continue
        code = np.full(len(flat) - n + 1, n, np.uint32)
        for j in range(n):
            code = (code * np.uint32(0x01000193)) ^ flat[j : len(flat) - n + 1 + j]
        code ^= code >> np.uint32(13)
        code *= np.uint32(0x5BD1E995)
        inside = word[: len(code)] == word[n - 1 :]
        codes.append((code >> np.uint32(15))[inside] & np.uint32(CHAR_BUCKETS - 1))
        owners.append(word[: len(code)][inside])
    code, owner = np.concatenate(codes).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], np.bincount(owner, minlength=len(lens))


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of so many words: the first words of its windows, and how many windows. The last ends with the text."""
    n = np.where(counts == 0, 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(step * STRIDE, np.repeat(np.maximum(0, counts - WINDOW), n)), n


class Words:
    """The words of some texts: distinct words with their inputs' buckets, and each word's number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = fold_case(data)
        starts, ends, self.before = word_bounds(data, offsets, WORD_BYTE)
        hashes = word_hashes(data, starts, ends)
        distinct, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)
        if len(distinct):
            self.grams, self.n_grams = char_grams(data, starts[first], ends[first])
        else:
            self.grams, self.n_grams = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def windows(self, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the words of all windows: windows x WINDOW, -1 past a text's end; the text of each window)."""
        counts, begins = np.diff(self.before), self.before[:-1]
        if texts is not None:
            counts, begins = counts[texts], begins[texts]
        starts, n = window_starts(counts)
        owner = np.repeat(np.arange(len(counts)), n)
        at = starts[:, None] + np.arange(WINDOW)
        inside = at < counts[owner][:, None]
        flat = np.where(inside, at + begins[owner][:, None], 0)
        return np.where(inside, self.number[flat] if len(self.number) else 0, -1), owner, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _both_ways(windows: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each step the rows that the windows' words have in two tables of so many rows, one upon the other, forwards and
    backwards (no word: a table's last row); and whether there is a word."""
    at = np.where(windows >= 0, windows, rows - 1).T
    there = (windows >= 0).T
    return np.hstack([at, at[::-1] + rows]), np.stack([there, there[::-1]], axis=1)[..., None]


def _summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the values (index x columns) that have each row as their index."""
    return np.stack([np.bincount(index, weights=c, minlength=rows) for c in np.ascontiguousarray(values.T)], axis=1).astype(np.float32)


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM

        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"word": normal(0.3, WORD_BUCKETS, WORD_DIM), "char": normal(0.6, CHAR_BUCKETS, CHAR_DIM)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": normal(d**-0.5, d, 3 * h), f"u{side}": normal(h**-0.5, h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal((2 * h) ** -0.5, 2 * h, h), "v": normal(h**-0.5, h), "o": normal((2 * h) ** -0.5, 2 * h), "o0": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        """The input of each distinct word."""
        chars = np.add.reduceat(self.p["char"][words.grams], np.cumsum(words.n_grams) - words.n_grams, axis=0) if len(words.grams) else np.zeros((0, CHAR_DIM), np.float32)
        return np.hstack([self.p["word"][words.bucket], chars / np.maximum(words.n_grams, 1)[:, None]]).astype(np.float32)

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word adds to the gates of either direction; the last row is that of no word."""
        return {s: np.vstack([x @ self.p[f"w{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) + self.p[f"c{s}"] for s in ("f", "b")}

    def run(self, tables: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False):
        """The logits of windows (word numbers, -1: none); with keep also what the gradient needs. Both directions take a step at
        once: the one at word t, the other at word t from the end."""
        b, h = len(windows), HIDDEN
        states = np.empty((WINDOW, b, 2 * h), np.float32)
        table, (places, on) = np.vstack([tables["f"], tables["b"]]), _both_ways(windows, len(tables["f"]))
        u, now, held = np.stack([self.p["uf"], self.p["ub"]]), np.zeros((2, b, h), np.float32), []
        full = on.all(axis=(1, 2, 3))
        for t in range(WINDOW):
            x, q = table[places[t]].reshape(2, b, 3 * h), now @ u
            gates = _sigmoid(x[:, :, : 2 * h] + q[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            n = np.tanh(x[:, :, 2 * h :] + r * q[:, :, 2 * h :])
            then = n + z * (now - n)
            if not full[t]:
                then = np.where(on[t], then, now)
            if keep:
                held.append((now, z, r, n, q[:, :, 2 * h :]))
            now = then
            states[t, :, :h], states[WINDOW - 1 - t, :, h:] = now
        e = np.tanh(states.reshape(-1, 2 * h) @ self.p["a"]).reshape(WINDOW, b, h)
        weight = e @ self.p["v"]
        weight[windows.T < 0] = -1e9
        weight -= weight.max(axis=0)
        np.exp(weight, out=weight)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logits = pooled @ self.p["o"] + self.p["o0"]
        return (logits, (states, held, e, weight, pooled)) if keep else logits

    def gradient(self, x: np.ndarray, words: Words, windows: np.ndarray, kept, d_logits: np.ndarray) -> dict[str, np.ndarray]:
        states, held, e, weight, pooled = kept
        h, p = HIDDEN, self.p
        g = {"o": pooled.T @ d_logits, "o0": d_logits.sum(keepdims=True)}
        d_pooled = d_logits[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled[None]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", d_score, e)
        d_e = (d_score[:, :, None] * p["v"]) * (1 - e * e)
        flat = d_e.reshape(-1, h)
        g["a"] = states.reshape(-1, 2 * h).T @ flat
        d_states += (flat @ p["a"].T).reshape(states.shape)
        b, v = len(windows), len(x) + 1
        places, on = _both_ways(windows, v)
        steps, u = np.empty((WINDOW, 2, b, 3 * h), np.float32), np.stack([p["uf"], p["ub"]])
        g_u, carried, back = np.zeros_like(u), np.zeros((2, b, h), np.float32), np.ascontiguousarray(u.transpose(0, 2, 1))
        for t in range(WINDOW - 1, -1, -1):
            before, z, r, n, q = held[t]
            d = np.stack([d_states[t, :, :h], d_states[WINDOW - 1 - t, :, h:]]) + carried
            new = d * on[t]
            d_n = new * (1 - z) * (1 - n * n)
            d_q = np.empty((2, b, 3 * h), np.float32)
            d_q[:, :, :h] = new * (before - n) * z * (1 - z)
            d_q[:, :, h : 2 * h] = d_n * q * r * (1 - r)
            d_q[:, :, 2 * h :] = d_n * r
            steps[t] = d_q
            steps[t, :, :, 2 * h :] = d_n
            g_u += before.transpose(0, 2, 1) @ d_q
            carried = d - new + new * z + d_q @ back
        d_both = _summed(places.ravel(), steps.reshape(-1, 3 * h), 2 * v)
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            d_table = d_both[k * v : k * v + v - 1]
            g[f"u{s}"], g[f"c{s}"], g[f"w{s}"] = g_u[k], d_table.sum(axis=0), x.T @ d_table
            d_x += d_table @ p[f"w{s}"].T
        g["word"] = _summed(words.bucket, d_x[:, :WORD_DIM], WORD_BUCKETS)
        g["char"] = _summed(words.grams, np.repeat(d_x[:, WORD_DIM:] / np.maximum(words.n_grams, 1)[:, None], words.n_grams, axis=0), CHAR_BUCKETS)
        return g

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window's logit of each text; -inf without words."""
        words = Words(data, offsets)
        tables = self.tables(self.inputs(words))
        out = np.full(len(offsets) - 1, -np.inf)
        texts = np.flatnonzero(np.diff(words.before))
        # texts in groups of bounded windows; a longer text is read on its own, its windows in parts
        _, n = window_starts(np.diff(words.before)[texts])
        for a, b in spans(np.concatenate([[0], np.cumsum(n)]), 8 * WINDOWS):
            windows, owner, _ = words.windows(texts[a:b])
            logits = np.concatenate([self.run(tables, windows[i : i + WINDOWS]) for i in range(0, len(windows), WINDOWS)])
            np.maximum.at(out, texts[a:b][owner], logits)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logits = self.text_logits(data, offsets)
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-(self.slope * np.where(np.isneginf(logits), 0, logits) + self.shift))))


def train(texts: list[str], toxic: list[int], seed: int = SEED) -> Network | None:
    """A calibrated network, or None without texts of both kinds."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = len(order) // 5
    held, used = order[:cut], order[cut:]
    if cut < 20 or y[held].min() == y[held].max():
        held = used = order
    net = Network(seed)
    words = Words(*utf8(pa.array(texts, pa.large_string())))
    has = np.diff(words.before) > 0
    used = used[has[used]]
    balance = np.where(y == 1, 0.5 / max(1.0, y[used].sum()), 0.5 / max(1.0, (1 - y[used]).sum())) * len(used)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    # small samples take more epochs, so that the number of steps stays in one range
    epochs = int(np.clip(EPOCHS * 1900 / max(1, len(used)), EPOCHS, 4 * EPOCHS))
    steps, step = epochs * -(-len(used) // BATCH_TEXTS), 0
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for i in range(0, len(shuffled), BATCH_TEXTS):
            step += 1
            some = shuffled[i : i + BATCH_TEXTS]
            windows, owner, n = words.windows(some)
            # only the batch's distinct words take part
            there, local = np.unique(windows, return_inverse=True)
            there, local = (there[1:], local.reshape(windows.shape) - 1) if there[0] == -1 else (there, local.reshape(windows.shape))
            part = _subset(words, there)
            x = net.inputs(part)
            logits, kept = net.run(net.tables(x), local, keep=True)
            begins = np.cumsum(n) - n
            top = np.maximum.reduceat(logits, begins)
            share = np.exp(logits - top[owner])
            total = np.add.reduceat(share, begins)
            bag = top + np.log(total / n)
            p = 1 / (1 + np.exp(-np.clip(bag, -30, 30)))
            d = ((p - y[some]) * balance[some] / len(some))[owner] * share / total[owner]
            g = net.gradient(x, part, local, kept, d.astype(np.float32))
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k in net.p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] * g[k] - second[k])
                net.p[k] -= (rate / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return calibrate(net, [texts[i] for i in held], y[held])


def _subset(words: Words, numbers: np.ndarray) -> Words:
    out = Words.__new__(Words)
    out.bucket, out.n_grams = words.bucket[numbers], words.n_grams[numbers]
    out.grams = words.grams[gather((np.cumsum(words.n_grams) - words.n_grams)[numbers], out.n_grams)]
    return out


def calibrate(net: Network, texts: list[str], y: np.ndarray) -> Network:
    """Slope and shift of the logistic function of the highest window's logit, by Newton steps with a small penalty."""
    logits = net.text_logits(*utf8(pa.array(texts, pa.large_string())))
    ok = np.isfinite(logits)
    x, y = np.column_stack([logits[ok], np.ones(ok.sum())]), y[ok]
    if not len(y) or y.min() == y.max():
        return net
    center, scale = x[:, 0].mean(), x[:, 0].std() + 1e-9
    x[:, 0] = (x[:, 0] - center) / scale
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 0.02 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (p - y) + 0.02 * w)
    net.slope, net.shift = float(max(w[0], 1e-3) / scale), float(w[1] - w[0] * center / scale)
    return net


def sample(labelled: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of at most POSITIVES and NEGATIVES rows (text, toxic, draw), the same whatever the partitioning. A row that
    is repeated is drawn once."""
    rows = labelled.where(F.col("toxic").isin(0, 1) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.groupBy("toxic", "draw", "text").agg(F.lit(1))
    most = F.when(F.col("toxic") == 1, POSITIVES).otherwise(NEGATIVES)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "text"))).where((F.col("k") <= max(POSITIVES, NEGATIVES)) & (F.col("k") <= most))
    found = sorted((r["toxic"], r["k"], r["text"]) for r in first.select("toxic", "k", "text").collect())
    return [t for _, _, t in found], [k for k, _, _ in found]


def _scored(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        scores = np.zeros(batch.num_rows)
        if net is not None:
            for a, b in spans(offsets, CHUNK_BYTES // 2):
                scores[a:b] = net.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score)."""
    return with_batch_rows(docs).select("doc_id", "text").mapInArrow(partial(_scored, net=net), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def _part() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network of the labelled rows that aren't held out. Labels are drawn first, so few texts meet them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(_part() != 0)
    known = known.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 2))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # long texts drop out later, so four times the wanted rows are drawn; the table is bounded by that and may be broadcast
    wanted = F.lit(False)
    for kind, most in ((0, NEGATIVES), (1, POSITIVES)):
        wanted = wanted | ((F.col("toxic") == kind) & (F.col("draw") <= min(DRAWS - 1, DRAWS * 4 * most // max(1, counts.get(kind, 0)))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.where(wanted)), "doc_id").select("text", "toxic", "draw")
    return train(*sample(rows))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    return found.select("doc_id", F.coalesce(_part() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

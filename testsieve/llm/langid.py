"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

Method. A text's subwords are its runs of 3 and 4 bytes, A-Z lower-cased and everything that isn't a letter a space; each
is hashed to one of BUCKETS embeddings of DIM numbers. The text is the mean of its embeddings, a linear layer and a softmax
give the languages' probabilities. The temperature of the softmax and the bound under which a prediction is rejected are
calibrated on rows that the training doesn't see: at most REJECT of the correctly labelled ones fall under the bound.

Training uses at most SAMPLE labelled rows of each language, drawn by a hash of their id and text, of at most SAMPLE_CHARS code
points each; prediction reads whole texts. Only text and lang of the rows given for training are used. A repeated row is drawn
once. Of the table the draw reads the languages for their counts, and the texts in one pass.

Defined cases: text that is null or has no letter is `und` with score 0 and rejected; so is all text if no row can train; null
lang doesn't train; repeated rows give repeated result rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, read_table, spans, utf8, with_batch_rows

GRAMS, BUCKETS, DIM = (3, 4), 1 << 16, 16
SAMPLE, SAMPLE_CHARS, EPOCHS, RATE, REJECT, SEED = 600, 20_000, 6, 0.5, 0.001, 7
#: A draw is a number below DRAWS. So many times the wanted rows are drawn, as long ones drop out then.
DRAWS, DRAWN = 1 << 62, 2
#: Windows whose logits are held at once. Texts go to the model in chunks of as many bytes; a longer one goes piece by piece.
PIECE = CHUNK_BYTES // 2

_FOLD = LOWER.copy()
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes from each position (the last n - 1 positions have none)."""
    code = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for j in range(n):
        code = code * np.uint32(0x01000193) + data[j : len(data) - n + 1 + j]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
    return (code >> np.uint32(16)) & np.uint32(BUCKETS - 1)


class Model:
    """languages, the logits that each bucket adds to a text's mean, the bias, the temperature and the bound for rejection."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, bound: float = 0.0) -> None:
        self.languages, self.table, self.bias, self.temperature, self.bound = languages, table, bias, temperature, bound

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of every row the logits before the temperature."""
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for n in GRAMS:
            # only a text of more than PIECE bytes makes more than one turn
            for lo in range(0, len(data) - n + 1, PIECE):
                folded = _FOLD[data[lo : lo + PIECE + n - 1]]
                code, blank = grams(folded, n), folded == 32
                void = blank[: len(code)].copy()
                for j in range(1, n):
                    void &= blank[j : j + len(code)]
                values = self.table[code]
                values[void] = 0
                begin, end = np.clip(offsets[:-1] - lo, 0, len(code)), np.clip(offsets[1:] - n + 1 - lo, 0, len(code))
                full = np.flatnonzero(end > begin)
                if len(full):
                    cuts = np.column_stack([begin[full], end[full]]).ravel()
                    cuts = cuts[:-1] if cuts[-1] == len(code) else cuts
                    total[full] += np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
                    count[full] += np.add.reduceat(~void, cuts, dtype=np.int64)[::2]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its probability)."""
        z = self.logits(data, offsets) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets and the share of each."""
    out = []
    for t in texts:
        data = _FOLD[np.frombuffer(t.encode(), np.uint8)]
        codes = [grams(data, n)[~np.all([data[j : len(data) - n + 1 + j] == 32 for j in range(n)], axis=0)] for n in GRAMS if len(data) >= n]
        b, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint32), return_counts=True)
        out.append((b.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model | None:
    """A calibrated model, or None without labelled texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(label) for label in labels])
    rng = np.random.default_rng(seed)
    features = _counts(texts)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, at = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rate = RATE * (1 - at / steps)
            at += 1
            b, share = features[i]
            if not len(b):
                continue
            hidden = share @ embed[b]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # the mean spreads a text's gradient thin over its buckets; scaled back to the size of a row
            embed[b] -= (rate * len(b) ** 0.5) * share[:, None] * step
    model = Model(languages, embed @ weights, bias.astype(float))
    return calibrate(model, [texts[i] for i in held], y[held])


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """Sets the temperature of least log loss, and the bound that rejects at most REJECT of the correctly predicted."""
    if not len(texts):
        return model
    z = model.logits(*utf8(pa.array(texts, pa.large_string())))

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    p = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    # never above an even choice between two languages, however sure the model is of the rows that it was calibrated on
    model.bound = float(min(0.5, right[int(REJECT * len(right))])) if len(right) else 0.0
    return model


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most per_language rows of each language, the same rows whatever the partitioning."""
    rows = labelled.where("lang is not null")
    # the bound of each language's draw follows from how many ids it has, so few rows more than wanted leave the tasks
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return [], []
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("draw") <= min(DRAWS - 1, DRAWS * DRAWN * per_language // n)))
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("draw")).where(wanted & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.groupBy("lang", "draw", "text").agg(F.lit(1))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("k") <= per_language)
    pairs = sorted((r["lang"], r["k"], r["text"]) for r in first.select("lang", "k", "text").collect())  # at most per_language of each
    return [t for _, _, t in pairs], [lang for lang, _, _ in pairs]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])[offsets]
    out = np.diff(ascii_letters) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict_rows(text: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of a text column."""
    data, offsets = utf8(text)
    langs, scores, rejected = np.full(len(text), "und", object), np.zeros(len(text)), np.ones(len(text), bool)
    if model is None:
        return langs.tolist(), scores, rejected
    names = np.array(model.languages, object)
    for a, b in spans(offsets, PIECE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ok = has_letter(part, at)
        best, p = model.predict(part, at)
        langs[a:b] = np.where(ok, names[best], "und")
        scores[a:b] = np.where(ok, p, 0.0)
        rejected[a:b] = ~ok | (p < model.bound)
    return langs.tolist(), scores, rejected


def _identify(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores, rejected = predict_rows(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, rejected)."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean"
    return with_batch_rows(docs).select("doc_id", "text").mapInArrow(partial(_identify, model=model), schema)


def _part() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def fit(docs: DataFrame) -> Model | None:
    """The model of the rows that aren't held out."""
    return train(*sample(docs.where(F.coalesce(_part() != 1, F.lit(True)))))


def op6_lang_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(_part() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def _accepted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(~predict_rows(batch.column("text"), model)[2]))


def langid_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model rejects; no row moves between tasks. Without labelled rows nothing can be rejected
    but texts without letters, so then a model of one class stands in."""
    model = fit(docs) or Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    return with_batch_rows(docs).mapInArrow(partial(_accepted, model=model), docs.schema)

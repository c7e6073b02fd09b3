"""Byte-level BPE, encoded and decoded in numpy.

Method. Texts are cut into words by the vocabulary's pattern; the distinct words of a batch that the worker hasn't met lie in
one flat array of symbols. In each round all neighbouring pairs are looked up at once by binary search over the sorted keys of
the merge table; in every word the pairs of its lowest rank merge, leftmost first, and words without a pair leave the array. What is left after
ROUNDS rounds are long words: their places wait in lists by rank, and a round looks up only pairs beside a merge, so a word of
any length takes time by its merges, not by its length for each of them. Texts are then put together from the words' ids by index arithmetic, and decoded the same way from the tokens' bytes.

The tokenizer file (of the `tokenizers` library) is a parameter: a path that every machine has. It is read, never trained.

Defined cases: null text counts as empty, which has no ids; strings of special tokens in a text become those tokens; a word of
any length is merged whole; repeated rows give repeated result rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, gather, read_table, spans, utf8, with_batch_rows

#: The pattern of byte-level BPE words, and the bytes that its alphabet writes as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Rounds over all symbols; words that need more go on by lists of places.
ROUNDS = 24

#: Words that a worker keeps with their ids; when there are more it begins anew with those of the chunk at hand.
KEPT_WORDS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The alphabet's characters and the bytes that they stand for; other bytes take characters from 256 on, in order."""
    plain = set(PLAIN_BYTES)
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One tokenizer file: encodes lists of texts and decodes ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in special.items():
            token_bytes[i] = token.encode()
        self.token_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.token_len = np.array([len(t) for t in token_bytes], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self._forget()

    def _forget(self) -> None:
        """Leaves only the special tokens, which are words of one id."""
        self.index: dict[str, int] = {token: i for i, token in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.at, self.n = np.arange(len(self.special)), np.ones(len(self.special), np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. No word may be empty."""
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_owner = [], []
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            pair = owner[1:] == owner[:-1]
            keys = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(pair & (self.keys[at] == keys), self.rank[at], len(self.keys))
            begins = np.flatnonzero(np.concatenate([[True], ~pair]))
            least = np.minimum.reduceat(np.append(rank, len(self.keys)), begins)
            counts = np.diff(np.append(begins, len(symbols)))
            alive = np.repeat(least < len(self.keys), counts)
            done_symbols.append(symbols[~alive])
            done_owner.append(owner[~alive])
            if not alive.any():
                break
            hit = np.append(rank, len(self.keys)) == np.repeat(least, counts)
            hit &= alive
            where = np.flatnonzero(hit)
            # of a run of hits that overlap, as in aaa, every second one counts
            new_run = np.concatenate([[True], np.diff(where) != 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[at[where]]
            alive[where + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        else:
            symbols, owner = self._by_rank(symbols, owner)
            done_symbols.append(symbols)
            done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (len(keys): none), and the symbol that it makes."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.rank[at], len(self.keys)), self.made[at]

    def _by_rank(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of the words that are left, lowest rank first. Symbols are a linked list; places wait under the rank of the
        pair that begins there, and count only if the pair still has it."""
        n, none = len(symbols), len(self.keys)
        owner = np.append(owner, -1)  # a last owner of its own ends every look to the right
        after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        symbols_ = np.append(symbols, 0)
        rank, made = np.full(n, none), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """The pairs that begin at the given places, now."""
            if not len(at):
                return
            right = after[at]
            found, makes = self._ranks(symbols_[at], symbols_[right])
            found = np.where(owner[at] == owner[right], found, none)
            rank[at], made[at] = found, makes
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            for r, part in zip(found[edges].tolist(), np.split(at, edges[1:])):
                if r == none:
                    continue
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(part)

        look(np.arange(n))
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[there[at] & (rank[at] == r)]
            if not len(at):
                continue
            # of a run of pairs that overlap every second one counts
            new_run = np.concatenate([[True], after[at[:-1]] != at[1:]])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            right = after[at]
            symbols_[at] = made[at]
            there[right] = False
            after[at] = after[right]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return symbols_[:n][there], owner[:n][there]

    def _learn(self, fresh: list[str]) -> None:
        flat, n = self.merge([w.encode() for w in fresh])
        at = np.cumsum(n) - n + len(self.flat)
        self.index.update(zip(fresh, range(len(self.n), len(self.n) + len(fresh))))
        self.flat, self.at, self.n = np.concatenate([self.flat, flat]), np.concatenate([self.at, at]), np.concatenate([self.n, n])

    def _cut_words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out = []
        for part in self.cut(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets of the texts (texts + 1 values)."""
        words, counts = [], []
        for t in texts:
            got = self._cut_words(t)
            counts.append(len(got))
            words += got
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh and len(self.index) + len(fresh) > KEPT_WORDS:
            self._forget()
            fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh:
            self._learn(fresh)
        number = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        n = self.n[number]
        ids = self.flat[gather(self.at[number], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other; bytes that aren't UTF-8 become replacement characters."""
        n = self.token_len[ids]
        data = self.token_flat[gather(self.token_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        names, text = batch.schema.names, batch.column("text")
        rest = [i for i, n in enumerate(names) if n != "text"]
        _, offsets = utf8(text)
        for a, b in spans(offsets, CHUNK_BYTES):
            part = batch.slice(a, b - a)
            ids, at = bpe.encode([t or "" for t in part.column("text").to_pylist()])
            texts = bpe.decode(ids, at)
            if digests:
                raw, ends = ids.astype("<u4").tobytes(), (4 * at).tolist()
                more = [
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(ends, ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *more], [*(names[i] for i in rest), "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *more], [*(names[i] for i in rest), "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>, decoded string)."""
    kind = dict(docs.dtypes)["doc_id"]
    return with_batch_rows(docs).select("doc_id", "text").mapInArrow(partial(_encoded, path=path or default_path(), digests=False), f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256): as encode(), but only digests leave the worker."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return with_batch_rows(docs).select("doc_id", "text").mapInArrow(partial(_encoded, path=path or default_path(), digests=True), schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return encode_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: every remaining document's token count and digests of ids and decoded text."""
    return encode_digests(docs)

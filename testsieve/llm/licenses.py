"""License scans by ordered signature rules.

Method. license_rules.txt holds some two hundred hand-written patterns with a label, a rank, a weight and keywords. A text's
keywords are found in one pass of an Aho-Corasick automaton; only rules whose keywords all occur are matched. Detections are
kept in the order of rank, length and rule; one that lies within a kept detection of the same or a better rank is suppressed.
The base phrases (BASE) are rules of their own that nothing suppresses. The score is one less the product of (1 - weight) over
the distinct labels that stay.

Texts are lower-cased in A-Z and scanned whole; words are runs of 0-9, a-z and non-ASCII characters, and the space of a
pattern stands for any run of other characters, one with a question mark for any run or none.

Defined cases: null counts as empty; a text without detections has no labels (empty strings) and score 0; repeated rows give
repeated result rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, LOWER, WORD_BYTE, read_table, spans, utf8, with_batch_rows, word_bounds

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_WEIGHT = 0.95

_WORD, _GAP, _MAYBE_GAP = r"[0-9a-z\x80-\xff]", r"[^0-9a-z\x80-\xff]+", r"[^0-9a-z\x80-\xff]*"


class Rule:
    def __init__(self, label: str, rank: int, weight: float, keywords: list[str], pattern: str, base: bool = False) -> None:
        self.label, self.rank, self.weight, self.keywords, self.base = label, rank, weight, keywords, base
        pattern = pattern.replace(" ?", _MAYBE_GAP).replace(" ", _GAP)
        self.pattern = re.compile(f"(?<!{_WORD})(?:{pattern})(?!{_WORD})")


def read_rules(text: str) -> list[Rule]:
    """One rule per line: label | rank | weight | keywords | pattern."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, rank, weight, keywords, pattern = (x.strip() for x in line.split(" | ", 4))
            out.append(Rule(label, int(rank), float(weight), keywords.split(","), pattern))
    return out


@lru_cache(maxsize=1)
def rules() -> tuple[list[Rule], ahocorasick.Automaton]:
    """All rules in order, base phrases first, and the automaton of their keywords."""
    found = [Rule(label, 0, BASE_WEIGHT, phrase.split(), phrase, True) for phrase, label in BASE.items()]
    found += read_rules((Path(__file__).parent / "license_rules.txt").read_text(encoding="utf-8"))
    automaton = ahocorasick.Automaton()
    # a keyword of several words is looked for by its longest, since any characters may lie between them
    for rule in found:
        rule.keywords = sorted({max(re.split(r"[^0-9a-z]+", k), key=len) for k in rule.keywords})
        for k in rule.keywords:
            automaton.add_word(k, k)
    automaton.make_automaton()
    return found, automaton


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule number) of all matches in a lower-cased text of one character per byte."""
    ordered, automaton = rules()
    present = {k for _, k in automaton.iter(text)}
    out = []
    if present:
        for i, rule in enumerate(ordered):
            if present.issuperset(rule.keywords):
                out += [(m.start(), m.end(), i) for m in rule.pattern.finditer(text)]
    return out


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without those that lie within one of the same or a better rank that stays; base phrases all stay."""
    ordered, _ = rules()
    kept: list[tuple[int, int, int]] = []
    for rank in sorted({ordered[i].rank for _, _, i in found}):
        some = sorted((d for d in found if ordered[d[2]].rank == rank), key=lambda d: (d[0], -d[1], d[2]))
        starts = sorted(kept)
        reach, ends = 0, []
        for s in starts:
            reach = max(reach, s[1])
            ends.append(reach)
        at, far = 0, 0
        fresh = []
        for d in some:
            while at < len(starts) and starts[at][0] <= d[0]:
                at += 1
            if rank == 0 or (d[1] > far and not (at and ends[at - 1] >= d[1])):
                fresh.append(d)
                far = max(far, d[1])
        kept += fresh
    return sorted(kept)


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordered, _ = rules()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        out = []
        for a, b in spans(offsets, CHUNK_BYTES):
            part, at = LOWER[data[offsets[a] : offsets[b]]], (offsets[a : b + 1] - offsets[a])
            starts, _, before = word_bounds(part, at, WORD_BYTE)
            counts, text, at = np.diff(before).tolist(), part.tobytes().decode("latin-1"), at.tolist()
            for r, n in enumerate(counts):
                kept = resolve(detect(text[at[r] : at[r + 1]])) if n else []
                if not kept:
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                # byte places to words and code points: words begin where detections do
                place = np.searchsorted(starts, np.array([s for s, _, _ in kept]) + at[r]) - before[r]
                head = part[at[r] : at[r + 1]]
                points = np.concatenate([[0], np.cumsum((head & 0xC0) != 0x80)])
                base = [int(p) for p, (_, _, i) in zip(place, kept) if ordered[i].base]
                base_labels = sorted({ordered[i].label for _, _, i in kept if ordered[i].base})
                weight: dict[str, float] = {}
                for _, _, i in kept:
                    weight[ordered[i].label] = max(weight.get(ordered[i].label, 0.0), ordered[i].weight)
                score = 1.0 - float(np.prod([1 - w for _, w in sorted(weight.items())]))
                told = [{"start": int(points[s]), "end": int(points[e]), "label": ordered[i].label} for s, e, i in kept]
                out.append((n, len(base), min(base, default=None), max(base, default=None), ",".join(base_labels), ",".join(sorted(weight)), score, told))
        columns = zip(*out) if out else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, _KINDS))], ["doc_id", *_NAMES])


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans in code points)."""
    return with_batch_rows(docs).select("doc_id", "text").mapInArrow(_scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, {_SCHEMA}")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Words, base phrases and labels of every document."""
    return scan(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")

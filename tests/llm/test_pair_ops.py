"""Operators that compare rows with one another, against brute force; the pipeline."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from testsieve.llm import bpe, components, decontam, line_dedup, simhash

ODD = [None, "", " ", "\n\n", "a", "é", "x" * 70_000, "word " * 20_000]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


class Words:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("abcdefghijklmnop") for _ in range(self.rng.randint(2, 8))) for _ in range(3000)]

    def text(self, n: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(n))

    def changed(self, text: str, n: int = 1) -> str:
        w = text.split(" ")
        for _ in range(n):
            i = self.rng.randrange(len(w))
            kind = self.rng.randrange(3)
            w[i : i + 1] = [self.rng.choice(self.words)] if kind == 0 else [] if kind == 1 and len(w) > 1 else [w[i], self.rng.choice(self.words)]
        return " ".join(w)


def roots(n: int, linked) -> list[int]:
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)))
        label[b] = a
    return [top(i) for i in range(n)]


class TestComponents:
    @pytest.mark.parametrize("seed", range(3))
    def test_against_union_find(self, spark, seed):
        rng = random.Random(seed)
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(30)] + [(5, 5)]
        label = roots(300, edges)
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        for i in range(300):
            assert got.get(i, i) == label[i]

    def test_no_edges(self, spark):
        assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class TestSimhash:
    def brute(self, prints: list[int]) -> list[int]:
        return roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])

    def test_documents(self, spark, tmp_path):
        w = Words(1)
        texts = [w.text(150) for _ in range(30)]
        texts += [w.changed(t, 1) for t in texts[:15] for _ in range(3)] + texts[:5] + ODD + ["one two", "ONE\ttwo", "mit x y"]
        frame(spark, texts).unionByName(spark.createDataFrame([(None, texts[0], "en", "s", 1), (4, texts[4], "en", "s", 1)], COLUMNS)).write.parquet(str(tmp_path / "documents.parquet"))
        prints = [fingerprint(t) for t in texts]
        label = self.brute(prints)
        got = simhash.op10_simhash_neardup(spark, str(tmp_path)).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            i = 0 if r["doc_id"] is None else r["doc_id"]
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[i]:016x}", label[i])

    def linked(self, spark, prints, **more):
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        rows = spark.createDataFrame([(p,) for p in signed], "fp long")
        edges = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.link(rows, **more).collect()]
        return roots(len(prints), edges)

    @pytest.mark.parametrize("most", [1 << 14, 100, 50])
    def test_links_of_a_dense_group(self, spark, most):
        rng = random.Random(2)
        prints = {rng.getrandbits(64) for _ in range(60)}
        center = rng.getrandbits(64)
        while len(prints) < 300:
            p = center
            for _ in range(rng.randint(0, 6)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
        prints = sorted(prints)
        assert self.linked(spark, prints, most=most) == self.brute(prints)

    def test_thresholds_cover_the_radius(self):
        rng = np.random.default_rng(0)
        for _ in range(5):
            t = simhash.allocate([rng.integers(0, int(rng.integers(1, 50)), 1 << 6) for _ in range(4)])
            assert sum(t) >= simhash.RADIUS - 4 + 1 and min(t) >= -1

    def test_uneven_thresholds_find_all(self, spark, monkeypatch):
        rng = random.Random(7)
        base = [rng.getrandbits(64) for _ in range(40)]
        prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) for b in base for _ in range(5)})
        for chosen in ([1, 0, 0, -1], [2, -1, 0, -1], [3, -1, -1, -1]):
            monkeypatch.setattr(simhash, "allocate", lambda h, r, c=chosen: c)
            assert self.linked(spark, prints) == self.brute(prints)

    def test_large_groups_in_blocks(self):
        rng = np.random.default_rng(1)
        fps = (np.uint64(rng.integers(0, 1 << 62)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))).astype(np.uint64)
        far = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        every = np.unique(np.concatenate([fps, far]))
        want = self.brute([int(x) for x in every])
        assert simhash._roots_of_group(every[:, None], simhash.STRICT, block=64).tolist() == want

    def test_similar_texts_against_brute_force(self, spark):
        w = Words(9)
        base = [w.text(120) for _ in range(25)]
        texts = base + [w.changed(t, n) for t in base for n in (1, 2, 4, 9, 20)] + ODD + ["one two three", "one two three four five"]
        rule = simhash.similar_rule()
        docs = frame(spark, texts)
        made = {r["doc_id"]: [np.uint64(r[c] % (1 << 64)) for c in rule.columns] for r in simhash.fingerprints(docs, rule=rule).collect()}
        x = np.array([made[i] for i in range(len(texts))], np.uint64)
        assert [int(f) for f in x[:, 0]] == [fingerprint(t) for t in texts]
        near = rule.near(x[:, None], x[None])
        label = roots(len(texts), zip(*(k.tolist() for k in np.nonzero(near))))
        got = {r["doc_id"]: r["rep"]["doc_id"] for r in simhash.near_duplicates(docs, rule).collect()}
        assert got == dict(enumerate(label))

        def similarity(a, b):
            a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
            return len(a & b) / len(a | b)

        pairs = [(i, j, similarity(texts[i], texts[j])) for i in range(25) for j in range(25, 150)]
        high, low = [p for p in pairs if p[2] >= 0.85], [p for p in pairs if p[2] < 0.5]
        assert len(high) > 30 and sum(bool(near[i, j]) for i, j, _ in high) >= 0.9 * len(high)
        assert sum(bool(near[i, j]) for i, j, _ in low) <= 0.002 * len(low)

    @staticmethod
    def shingle_set(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def edited(self, w, text, n, block):
        words = text.split()
        at = w.rng.randrange(len(words) - n) if block else None
        for i in range(at, at + n) if block else w.rng.sample(range(len(words)), n):
            words[i] = w.rng.choice(w.words)
        return " ".join(words)

    @pytest.mark.parametrize("block", [1000, 2])
    def test_similar_duplicates_at_the_bound(self, spark, monkeypatch, block):
        monkeypatch.setattr(simhash, "BLOCK", block)
        w = Words(21)
        base = [w.text(300) for _ in range(100)]
        texts = base + [self.edited(w, t, w.rng.randint(4, 10), False) for t in base] + [self.edited(w, t, w.rng.randint(20, 50), True) for t in base]
        middle = w.text(200)
        texts += [middle, *(self.edited(w, middle, 3, False) for _ in range(12))]
        sets = [self.shingle_set(t) for t in texts]
        like = [(i, j, len(a & b) / len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a & b]
        assert sum(0.8 <= s < 0.85 for _, _, s in like) > 20 and sum(0.7 <= s < 0.8 for _, _, s in like) > 40
        prints = [fingerprint(t) for t in texts]
        want = roots(len(texts), [(i, j) for i, j, s in like if s >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 3])
        got = {r["doc_id"]: r["rep"]["doc_id"] for r in simhash.similar_duplicates(frame(spark, texts)).collect()}
        assert got == dict(enumerate(want))

    @pytest.mark.parametrize("most", [1 << 14, 60])
    def test_wide_radius_in_a_dense_group(self, spark, most):
        rng = random.Random(4)
        rows = set()
        for c in [[rng.getrandbits(64) for _ in range(3)] for _ in range(20)]:
            for _ in range(15 if len(rows) else 150):
                rows.add(tuple(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for x in c))
        rows = sorted(rows)
        signed = [tuple(x - (1 << 64) if x >> 63 else x for x in r) for r in rows]
        rule, x = simhash.similar_rule(), np.array(rows, np.uint64)
        node = {int(n): i for i, n in enumerate(rule.nodes(x))}
        edges = [(node[r["a"]], node[r["b"]]) for r in simhash.link(spark.createDataFrame(signed, "fp long, s0 long, s1 long"), rule, most).collect()]
        assert roots(len(rows), edges) == roots(len(rows), zip(*(k.tolist() for k in np.nonzero(rule.near(x[:, None], x[None])))))

    def test_stage(self, spark, tmp_path):
        w = Words(3)
        base = [w.text(200) for _ in range(6)]
        docs = frame(spark, base + [base[0], w.changed(base[1])] + ODD).withColumn("_uid", F.lit(1))
        twice = docs.union(docs.where("doc_id = 2"))
        got = simhash.dedup_stage(spark, twice, "")
        assert got.columns == docs.columns
        prints = [fingerprint(t) for t in [*base, base[0], w.text(1)]]
        kept = sorted(r["doc_id"] for r in got.collect())
        assert kept[:6] == list(range(6)) and 6 not in kept and len(kept) == len(set(kept)) and len(prints) == 8
        assert simhash.dedup_stage(spark, docs.where("false"), "").count() == 0
        maps = docs.withColumn("rep", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("node", F.array(F.create_map(F.lit(1), F.lit("x"))))
        assert sorted(r["doc_id"] for r in simhash.dedup_stage(spark, maps.union(maps.where("doc_id < 3")), "").collect()) == kept
        docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
        assert simhash.op10_simhash_neardup(spark, str(tmp_path)).count() == 0


class TestLineDedup:
    def brute(self, docs):
        """Whether each line goes, by comparing it with every earlier one."""
        seen, out = [], {}
        for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
            kept = []
            for line in (t or "").split("\n"):
                if line.strip(" \t\r\x0b\x0c") and any(self.near(line, s) for s in seen):
                    seen.append(line)
                    continue
                kept.append(line)
                if line.strip(" \t\r\x0b\x0c"):
                    seen.append(line)
            out[d] = None if t is None else "\n".join(kept)
        return out

    @staticmethod
    def near(a: str, b: str) -> bool:
        if a == b:
            return True
        x, y = a.split(" "), b.split(" ")
        n, m = len(x), len(y)
        if abs(n - m) > 1 or max(n, m) < line_dedup.MIN_WORDS:
            return False
        p = next((i for i in range(min(n, m)) if x[i] != y[i]), min(n, m))
        s = next((i for i in range(min(n, m) - p) if x[n - 1 - i] != y[m - 1 - i]), min(n, m) - p)
        return p + s >= max(n, m) - 1

    @pytest.mark.parametrize("seed", range(3))
    def test_against_brute_force(self, spark, seed):
        w, rng = Words(seed), random.Random(seed)
        w.words = w.words[:40]
        lines = [w.text(rng.randint(1, 9)) for _ in range(60)]
        texts = ["\n".join(rng.choice([rng.choice(lines), w.changed(rng.choice(lines)), "", "  ", w.text(rng.randint(1, 7)), "a  b c  d e"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
        texts += [None, "", "\n", "é è ê ë ē", "é è x ë ē"]
        want = self.brute(list(enumerate(texts)))
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
        assert got == want

    def test_repeated_rows_against_brute_force(self, spark):
        w = Words(9)
        w.words = w.words[:30]
        lines = [w.text(8) for _ in range(20)]
        texts = ["\n".join(w.changed(lines[(3 * i + k) % 20]) for k in range(4)) for i in range(15)]
        docs = frame(spark, texts)
        many = docs.union(docs.where("doc_id % 3 = 0")).union(docs.where("doc_id = 3").select(docs.columns).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
        want, got = self.brute(list(enumerate(texts))), defaultdict(list)
        for r in line_dedup.dedup_lines(many).collect():
            got[r["doc_id"]].append(r["text"])
        assert {d: set(t) for d, t in got.items()} == {d: {t} for d, t in want.items()}
        assert len(got[3]) == 3002 and len(got[6]) == 2 and len(got[1]) == 1

    def test_a_very_long_line(self, spark):
        rng = random.Random(4)
        words = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
        texts = [" ".join(words), " ".join(words[:700] + words[701:]), " ".join(words[:700] + words[702:])]
        got = {r["doc_id"]: len(r["text"]) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
        assert got == {0: len(texts[0]), 1: 0, 2: 0}

    def test_a_hot_place(self, spark):
        texts = [f"this line has the number {i} in it" for i in range(300)] + ["this line has the number in it", "another line that stays as it is"]
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
        assert {k for k, v in got.items() if v} == {0, 301}

    def test_columns_rows_and_nulls(self, spark, tmp_path):
        docs = frame(spark, ["same\nline", "same\nother", *ODD]).withColumn("kept", F.lit("k")).withColumn("gone", F.lit(1))
        docs = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
        got = line_dedup.line_dedup_stage(spark, docs, "")
        assert got.columns == docs.columns and got.count() == docs.count()
        rows = defaultdict(list)
        for r in got.collect():
            rows[r["doc_id"]].append((r["text"], r["n_chars"], r["kept"]))
        assert rows[1] == [("other", 5, "k")] * 2 and rows[None] == [("", 0, "k")] and rows[0] == [("same\nline", 9, "k")] and rows[2] == [(None, None, "k")]
        docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
        assert line_dedup.op7_line_dedup(spark, str(tmp_path)).count() == 0


class TestDecontamination:
    @pytest.fixture
    def items(self):
        w = Words(4)
        return [w.text(n) for n in (15, 20, 20, 30, 45, 59)] + ["Of five words, just so.", "two words", "One"]

    def test_finds_what_is_there(self, spark, items, tmp_path):
        w = Words(5)
        texts = [w.text(80) + " " + t + ". " + w.text(30) for t in items[:6]] + [items[3].upper(), items[4].replace(" ", ",\n"), w.text(200), "x " + items[6], items[7], "one", *ODD]
        bench = spark.createDataFrame([*enumerate(items), (98, None), (99, ""), (None, "null id")], "item_id long, text string").withColumn("similarity", F.lit(0))
        texts[8] = w.text(200) + " null id, but a text of some words all the same"
        bench = bench.union(spark.createDataFrame([(None, "null id, but a text of some words all the same", 0)], bench.schema))
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(frame(spark, texts), bench).collect()}
        assert got.pop((8, None))["similarity"] > 0.999
        want = {(i, i) for i in range(6)} | {(6, 3), (7, 4), (9, 6), (10, 7), (11, 8)}
        assert set(got) == want and all(r["similarity"] > 0.999 for r in got.values())
        assert (got[0, 0]["first_word"], got[0, 0]["n_words"]) == (80, 15)
        clean = decontam._clean  # the stage drops what is found and nothing else
        found = decontam.Items([r[0] for r in enumerate(items)], items)
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        assert next(clean(iter([batch]), found)).num_rows == len(texts) - len({d for d, _ in want})
        odd = frame(spark, texts).withColumn("items", F.lit("x")).withColumn("keep", F.create_map(F.lit("a"), F.lit(1)))
        bench.write.parquet(str(tmp_path / "benchmark.parquet"))
        kept = decontam.decontam_stage(spark, odd, str(tmp_path))
        assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} - {8}

    def test_near_passages_against_brute_force(self, items):
        w = Words(6)
        item = items[5]
        found = decontam.Items([1], [item])
        for n in range(0, 8):
            for _ in range(6):
                text = w.text(20) + " " + (w.changed(item, n) if n else item) + " " + w.text(20)
                words = decontam.word_hashes(*self.words_of(text))
                best = 0.0
                for i in range(len(words) - 59 + 1):
                    best = max(best, found.verify(0, decontam.shingle_hashes(words[i : i + 59], 5)))
                data, offsets = decontam.utf8(pa.array([text]))
                got = list(decontam.found_in(data, offsets, found))
                assert bool(got) == (best >= 0.8)
                if got:
                    assert got[0][2] == pytest.approx(best)

    @staticmethod
    def words_of(text):
        data = decontam.fold_case(np.frombuffer(text.encode(), np.uint8))
        starts, ends, _ = decontam.word_bounds(data, np.array([0, len(data)]), decontam.WORD_BYTE)
        return data, starts, ends

    def test_index_finds_all_within_the_radius(self, monkeypatch):
        rng = np.random.default_rng(3)
        base = rng.integers(0, 1 << 62, 20).astype(np.uint64)
        near = base.copy()
        for i in range(20):
            for b in rng.choice(64, rng.integers(0, 26), replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        index = decontam.MultiIndex(base)
        got = set(zip(*(x.tolist() for x in index.search(near))))
        monkeypatch.setattr(decontam, "PAIRS", 60)
        assert set(zip(*(x.tolist() for x in index.search(near)))) == got
        want = {(q, i) for q in range(20) for i in range(20) if (int(near[q]) ^ int(base[i])).bit_count() <= decontam.RADIUS}
        assert got == want

    def test_recall_about_the_bound(self):
        """Passages of similarity 0.8 to 0.9, by the exact similarity of their best window."""
        w, caught, all_ = Words(12), 0, 0
        texts = [w.text(n) for n in (20, 40, 80) for _ in range(12)]
        items = decontam.Items(list(range(len(texts))), texts)
        for j, item in enumerate(texts):
            for n in range(1, 9):
                passage = w.changed(item, n) if n % 2 else " ".join(item.split(" ")[: -n or None]) + " " + w.text(n)
                near, size = [], items.words[j]
                words = decontam._words(pa.array([w.text(10) + " " + passage + " " + w.text(10)], pa.large_string()))[0]
                for i in range(len(words) - size + 1):
                    near.append(items.verify(j, decontam.shingle_hashes(words[i : i + size], 5)))
                if 0.8 <= max(near) < 0.9:
                    all_ += 1
                    data, offsets = decontam.utf8(pa.array([w.text(10) + " " + passage + " " + w.text(10)]))
                    caught += any(f[1] == j for f in decontam.found_in(data, offsets, items))
        assert all_ > 30 and caught / all_ >= 0.95

    def test_many_short_items(self):
        w = Words(13)
        texts = [w.text(6) for _ in range(20_000)]
        items = decontam.Items(list(range(len(texts))), texts)
        data, offsets = decontam.utf8(pa.array([w.text(30) + " " + texts[i] + " " + w.text(30) for i in range(0, 20_000, 200)]))
        assert {(r, i) for r, i, *_ in decontam.found_in(data, offsets, items)} >= {(k, 200 * k) for k in range(100)}

    def test_empty_sides(self, spark, items):
        none = spark.createDataFrame([], "item_id long, text string")
        assert decontam.contaminated(frame(spark, items), none).count() == 0
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        assert decontam.contaminated(frame(spark, items).where("false"), bench).count() == 0

    def test_items_in_blocks(self, spark, items):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        blocks = list(decontam.item_blocks(bench, 200))
        assert len(blocks) > 2 and sorted(i for b in blocks for i in b.ids) == list(range(len(items)))

    def test_one_block_and_many_find_the_same(self, spark):
        w = Words(31)
        stem = w.text(20)
        # all share a stem, so its weights depend on how many items are counted; changed passages lie about the bound
        items = [stem + " " + w.text(40) for _ in range(30)]
        texts = [w.text(30) + " " + w.changed(t, n) + " " + w.text(30) for t in items for n in (1, 1, 2)]
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        data, offsets = decontam.utf8(pa.array(texts))

        def matches(most):
            blocks = list(decontam.item_blocks(bench, most))
            return len(blocks), sorted((row, item, round(s, 9), first, n) for b in blocks for row, item, s, first, n in decontam.found_in(data, offsets, b))

        (one, whole), (many, parts) = matches(1 << 22), matches(300)
        assert one == 1 and many > 10 and parts == whole
        assert 10 < len({r[0] for r in whole}) < len(texts)


class TestPipeline:
    def test_clashing_names_nulls_and_repeats(self, spark, tmp_path):
        """Stages that filter keep all columns, whatever their names; the last one gives its own."""
        from testsieve.llm import langid

        w = Words(21)
        docs = frame(spark, [w.text(30), w.text(30), "123", *ODD]).withColumns({"score": F.lit("s"), "rejected": F.lit(None).cast("int"), "ids": F.lit(1), "n_tokens": F.lit("n")})
        docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
        kept = langid.langid_stage(spark, docs, "")
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, None}
        assert kept.where("doc_id = 0").count() == 2 and kept.where("doc_id = 2 or text is null").count() == 0
        last = bpe.bpe_stage(spark, docs, "")
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
        for stage in (langid.langid_stage, bpe.bpe_stage):
            assert stage(spark, docs.where("false"), "").count() == 0

    def test_stages(self, spark, tmp_path):
        w = Words(8)
        items = [w.text(25)]
        line = "this very line is said by two documents"
        texts = [w.text(120), w.text(120) + "\n" + line, line + "\n" + w.text(120), w.text(50) + " " + items[0] + " " + w.text(50), "123 456", None, ""]
        texts += [texts[0]]
        frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        seen = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
            docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
            seen[name] = {r["doc_id"]: r for r in docs.collect()}
        names = [n for n, _ in corpus_pipeline.STAGES]
        assert set(seen[names[0]]) == {0, 1, 2, 3, 7}
        assert line in seen[names[1]][1]["text"] and line not in seen[names[1]][2]["text"] and seen[names[1]][7]["text"] == ""
        assert set(seen[names[2]]) == {0, 1, 2, 3, 7}
        assert set(seen[names[3]]) == {0, 1, 2, 7}
        last = seen[names[4]]
        codec = bpe.codec(bpe.default_path())
        assert last[0]["n_tokens"] == len(codec.encode([texts[0]])[0]) and last[7]["n_tokens"] == 0
        got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
        assert got == last

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from testsieve.operators import cluster, entropy, findings, metrics, pairs, reduce, safety, sketch, store, tfidf


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(more[k][i] for k in more)) for i, r in enumerate(x)]
    kinds = "".join(f", {k} long" for k in more)
    return spark.createDataFrame(rows, f"id long, v array<double>{kinds}")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(42)
    return np.vstack([rng.normal(c, 1.0, (10, 2)) for c in ((0, 0), (9, 9), (-9, 9))])


def test_change_impact(spark):
    lines = spark.createDataFrame([(1, "a", n) for n in (10, 15, 16, 40)] + [(2, "b", 10)], "test_case_id long, file string, line long")
    changes = spark.createDataFrame([("a", 10)], "file string, line long")
    got = {r["test_case_id"]: (r["direct"], r["nearby"], r["impact"]) for r in store.change_impact(lines, changes).collect()}
    assert got == {1: (1, 1, pytest.approx(0.325)), 2: (0, 0, 0)}


def test_text_blocks_keep_the_last_block_with_rows(spark):
    text = ["junk", "TEST: a", "f.php:1", "", "TEST: b", "TEST: a", "g.php:2", "no line", "TEST: a"]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "source string, pos int, text string")
    assert [(r["test"], r["file"], r["line"]) for r in store.text_blocks(lines).collect()] == [("a", "g.php", 2)]


def test_uniqueness(spark):
    lines = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 2)], "test_case_id long, file string, line long")
    assert {r["test_case_id"]: r["uniqueness"] for r in store.uniqueness(lines).collect()} == {1: 0.5, 2: 0}


def test_association_falls_back_to_all_tests(spark):
    files = spark.createDataFrame([("src/User.php",), ("src/Other.php",)], "file string")
    tests = spark.createDataFrame([(1, "tests/UserCase"), (2, "x")], "id long, path string")
    got = sorted((r["file"], r["test_case_id"]) for r in store.associate(files, tests).collect())
    assert got == [("src/Other.php", 1), ("src/Other.php", 2), ("src/User.php", 1)]


def test_blocks_make_every_pair_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    rows = frame(spark, x).select(F.lit(1).cast("long").alias("grp"), "id", "v")
    got = {(r["a"], r["b"]): r["score"] for r in pairs.pair_scores(rows, size=7).collect()}
    assert len(got) == 60 * 59 // 2
    for (a, b), s in got.items():
        assert a < b and s == pytest.approx(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]))


def test_silhouette_of_separate_blobs(spark, blobs):
    labels = [i // 10 for i in range(30)]
    rows = frame(spark, blobs, label=labels)
    s = metrics.silhouettes(rows).agg(F.avg("silhouette")).first()[0]
    d = np.linalg.norm(blobs[:, None] - blobs[None], axis=2)
    want = []
    for i in range(30):
        own = [d[i, j] for j in range(30) if labels[j] == labels[i] and j != i]
        other = min(np.mean([d[i, j] for j in range(30) if labels[j] == k]) for k in set(labels) - {labels[i]})
        want.append((other - np.mean(own)) / max(other, np.mean(own)))
    assert s == pytest.approx(np.mean(want))


def test_kmeans_finds_blobs(spark, blobs):
    rows = frame(spark, blobs)
    got = [r["cluster_id"] for r in cluster.kmeans(rows, 3).orderBy("id").collect()]
    assert len({tuple(got[i : i + 10]) for i in (0, 10, 20)}) == 3 and all(len(set(got[i : i + 10])) == 1 for i in (0, 10, 20))
    assert cluster.best_k(rows, 2, 5) == 3


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows(spark, n):
    rows = frame(spark, np.arange(2 * n).reshape(n, 2))
    assert cluster.kmeans(rows, 2).count() == n
    assert cluster.agglomerative(rows, k=2).count() == n


def test_bad_vectors_are_refused(spark):
    with pytest.raises(ValueError, match="finite"):
        cluster.check(frame(spark, [[float("nan")]]))
    with pytest.raises(ValueError, match="columns"):
        cluster.check(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"))


def test_dbscan_against_the_textbook(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.4, (25, 2)), rng.normal(4, 0.4, (20, 2)), rng.uniform(-8, 8, (10, 2))])
    eps, least = 0.6, 4
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(axis=1) >= least
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j]):
                    if label[m] < 0:
                        label[m] = k
                        if core[m]:
                            todo.append(m)
            k += 1
    got = [r["cluster_id"] for r in cluster.dbscan(frame(spark, x), eps, least).orderBy("id").collect()]
    assert got == label.tolist()


def test_merges_against_naive_linkage():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25, 3))
    for linkage in ("complete", "single", "average"):
        groups, heights = [[i] for i in range(25)], []
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        f = {"complete": np.max, "single": np.min, "average": np.mean}[linkage]
        while len(groups) > 1:
            h, a, b = min((f(d[np.ix_(p, q)]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
            heights.append(h)
            groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]
        assert cluster.merges(x, linkage)[:, 2] == pytest.approx(heights)


def test_ward_cut(blobs):
    labels = cluster.cut_tree(cluster.merges(blobs), 30, k=3)
    assert labels.tolist() == [0] * 10 + [1] * 10 + [2] * 10


def test_small_clusters_join_the_largest(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 5, 7, 9, 9, -1])], "id long, cluster_id long")
    assert [r["cluster_id"] for r in cluster.merge_small(rows).orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, -1]


def test_pca(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 10))
    x[:, 0] *= 5
    pca = reduce.PCA(4, standardized=False).fit(frame(spark, x))
    got = np.array([r["v"] for r in pca.transform(frame(spark, x)).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :4] * s[:4]), abs=1e-8)
    assert pca.explained() == pytest.approx((s**2 / (s**2).sum())[:4])
    with pytest.raises(ValueError, match="not fitted"):
        reduce.PCA(2).transform(frame(spark, x))


def test_tsne_keeps_blobs_apart(spark, blobs):
    got = np.array([r["v"] for r in reduce.tsne(frame(spark, blobs), perplexity=5, rounds=300).orderBy("id").collect()])
    d = np.linalg.norm(got[:, None] - got[None], axis=2)
    same = np.repeat(np.arange(3), 10)[:, None] == np.repeat(np.arange(3), 10)[None]
    assert d[same].mean() < 0.5 * d[~same].mean()
    with pytest.raises(ValueError, match="3 dimensions"):
        reduce.tsne(frame(spark, blobs), dims=4)


def test_minhash_estimates_weighted_overlap(spark):
    sets = {1: set(range(0, 60)), 2: set(range(20, 80)), 3: set()}
    lines = spark.createDataFrame([(t, "f", n) for t, s in sets.items() for n in s], "test_case_id long, file string, line long")
    ids = spark.createDataFrame([(t,) for t in sets], "id long")
    sig = {r["test_case_id"]: r["signature"] for r in sketch.weighted_minhash(lines, ids, n=1024, skip_shared=False, use_idf=False).collect()}
    assert np.mean(np.abs(np.array(sig[1]) - np.array(sig[2])) < 1e-12) == pytest.approx(40 / 80, abs=0.06)
    assert set(sig[3]) == {0.0}


def test_greedy_split_keeps_opposites_apart(spark):
    names = spark.createDataFrame([(1, n) for n in ("test_create_user", "test_delete_user", "test_list_user", "test_remove_user_now")], "cluster_id long, name string")
    got = {}
    for r in safety.split_opposing(names).collect():
        got.setdefault(r["sub"], set()).add(r["name"])
    assert got == {0: {"test_create_user", "test_list_user"}, 1: {"test_delete_user", "test_remove_user_now"}}
    split = {}
    for r in safety.split_unsafe(names).collect():
        split.setdefault(r["cluster_id"], set()).add(r["name"])
    assert split == {2: got[0], 3: got[1]}


def test_missing_parts_are_zero(spark):
    sem, cov = frame(spark, [[3.0, 0.0], [1.0, 1.0]]), frame(spark, [[4.0]])
    got = {r["id"]: r["v"] for r in entropy.combine(sem, cov, 2, 1).collect()}
    assert got[0] == pytest.approx([0.6, 0, 0.8]) and got[1][2] == 0
    with pytest.raises(Exception, match="vectors must have 3 columns"):
        entropy.combine(sem, cov, 3, 1).collect()


def test_projection_keeps_angles(spark):
    rng = np.random.default_rng(0)
    m = tfidf.projection(2000, 256)
    a = rng.normal(size=2000)
    b = a + 0.3 * rng.normal(size=2000)
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert cos(a @ m, b @ m) == pytest.approx(cos(a, b), abs=0.1)
    assert tfidf.projection(3, 5).tolist() == np.eye(3, 5).tolist()


def test_noise_can_be_left_out(spark):
    members = spark.createDataFrame([(-1, 1), (-1, 2), (0, 3), (0, 4)], "cluster_id long, id long")
    none = spark.createDataFrame([], "grp long, a long, b long, score double")
    assert findings.redundant_tests(members, none).count() == 4
    assert findings.redundant_tests(members, none, include_noise=False).count() == 2

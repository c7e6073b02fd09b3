"""Operators over more rows than one block, one task or one key should hold."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from testsieve.operators import cluster, metrics, pairs, reduce, sketch, tsne
from testsieve.plans import catalog


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(more[k][i] for k in more)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {k} long" for k in more))


def distances(x):
    return np.linalg.norm(x[:, None] - x[None], axis=2)


@pytest.fixture
def crowded(monkeypatch):
    """Few and small blocks, so that small tables have several."""
    monkeypatch.setattr(pairs, "GRID", 3)
    monkeypatch.setattr(pairs, "NUMBERS", 4000)


def test_wide_blocks_are_few(spark):
    rows = frame(spark, np.zeros((2000, 1)), grp=[0] * 2000)
    assert pairs.blocks(rows, 10).count() > 150
    assert pairs.blocks(rows, 10, wide=True).count() <= pairs.GRID
    assert pairs.block_pairs(rows, 10, wide=True).agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] <= 2000 * (pairs.GRID + 1)


def test_quantiles_of_all_distances(spark, crowded):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(900, 5)), np.ones((300, 5)), rng.normal(size=(100, 5)) * 1e-4 + 3])
    d = distances(x)[np.triu_indices(len(x), 1)]
    got = metrics.pair_distance_stats(frame(spark, x)).first().asDict()
    want = {"min": d.min(), "max": d.max(), "mean": d.mean(), "std": d.std()} | {f"p{q}": np.percentile(d, q) for q in metrics.PERCENTILES}
    assert got == pytest.approx(want, abs=1e-6)
    assert set(metrics.pair_distance_stats(frame(spark, x[:1])).first()) == {None}


def test_tiles_of_wide_blocks(spark, crowded):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1000, 4)), np.zeros((300, 4))])
    d, label = distances(x), rng.integers(0, 3, 1300)
    near = {r["id"]: r["score"] for r in pairs.nearest(frame(spark, x), 3).where("place = 3").collect()}
    assert [near[i] for i in range(1300)] == pytest.approx(np.sort(d, axis=1)[:, 3], abs=1e-6)
    sums = pairs.label_sums(frame(spark, x, label=label.tolist())).collect()
    assert len(sums) == 3 * 1300
    assert all(r["n"] == (label == r["other"]).sum() and abs(r["total"] - d[r["id"], label == r["other"]].sum()) < 1e-4 for r in sums)
    scored = pairs.pair_scores(frame(spark, x, grp=[0] * 1300), pairs.euclidean_kernel, most=0.5)
    i, j = np.nonzero(np.triu(d <= 0.5, 1))
    assert {(r["a"], r["b"]) for r in scored.collect()} == set(zip(i.tolist(), j.tolist(), strict=True))


def test_thresholds_of_groups(spark, crowded):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(1400, 3)), [[0.0, 0, 0]] * 3])
    group = [0 if i < 900 else 1 if i < 1402 else 2 for i in range(1403)]
    rows = frame(spark, x, grp=group)
    got = {r["grp"]: r["threshold"] for r in metrics.threshold(rows, 0.3).collect()}
    want = {}
    for g in (0, 1):
        y = x[np.array(group) == g]
        s = pairs.cosine_kernel(y, y)[np.triu_indices(len(y), 1)]
        want[g] = np.quantile(s, 0.3)
    assert got == pytest.approx(want, abs=1e-9)


@pytest.fixture
def passes(monkeypatch):
    """Grows by one with each pass over all pairs of blocks."""
    made, paired = [], pairs._paired
    monkeypatch.setattr(pairs, "_paired", lambda b, *more: made.append(1) or paired(b, *more))
    return made


def test_best_k_sees_the_pairs_once(spark, passes):
    rng = np.random.default_rng(7)
    rows = frame(spark, np.vstack([rng.normal(c, 0.5, (40, 2)) for c in ((0, 0), (9, 9), (-9, 9), (9, -9))]))
    assert cluster.best_k(rows) == 4
    assert len(passes) == 1


def test_silhouettes_of_several_labellings(spark, crowded):
    rng = np.random.default_rng(8)
    x, a, b = rng.normal(size=(1300, 3)), rng.integers(0, 4, 1300), np.minimum(np.arange(1300), 2)
    got = metrics.mean_silhouettes(frame(spark, x, a=a.tolist(), b=b.tolist(), c=[0] * 1300), ["a", "b", "c"])
    want = [metrics.silhouettes(frame(spark, x, label=y.tolist())).agg(F.avg("silhouette")).first()[0] for y in (a, b, np.zeros(1300, int))]
    assert got == pytest.approx(want)


def test_best_radius_scores_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = frame(spark, np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5))]))
    made, scored = [], cluster.pair_scores
    monkeypatch.setattr(cluster, "pair_scores", lambda *a, **b: made.append(1) or scored(*a, **b))
    cluster.best_eps(rows, 4)
    assert len(made) == 1


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_linkage_by_rounds_is_that_of_one_task(spark, monkeypatch, linkage):
    monkeypatch.setattr(cluster, "AGGLOMERATIVE_MOST", 12)
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 1.0, (60, 9)) for c in (0, 4, 8)] + [np.full((30, 9), 2.0)])
    want = cluster.merges(x, linkage)
    got = cluster.dendrogram(frame(spark, x), linkage).orderBy("step").collect()
    assert [r["distance"] for r in got] == pytest.approx(want[:, 2], abs=1e-6) and got[-1]["size"] == len(x)
    for k in (2, 3, 7):
        labels = [r["cluster_id"] for r in cluster.agglomerative(frame(spark, x), linkage, k=k).orderBy("id").collect()]
        assert labels == cluster.cut_tree(want, len(x), k).tolist()


def test_linkage_of_ties_and_copies_ends(spark, monkeypatch):
    monkeypatch.setattr(cluster, "AGGLOMERATIVE_MOST", 5)
    grid = np.array([[i, j] for i in range(12) for j in range(12)] + [[50, 50]] * 40)
    got = cluster.dendrogram(frame(spark, grid), "single").collect()
    assert sorted(r["distance"] for r in got)[:-1] == pytest.approx([0] * 39 + [1] * 143)


def test_average_linkage_around_a_hub_takes_few_rounds(spark, monkeypatch):
    # each is nearest to the cluster in the middle, so that rounds of mutual nearest clusters merge one pair each
    monkeypatch.setattr(cluster, "AGGLOMERATIVE_MOST", 5)
    r = 3 + np.arange(1, 41) / 10
    x = np.vstack([np.diag(r), np.zeros((3, 40)), np.ones((2, 40))])
    want, jobs, run = cluster.merges(x, "average"), [], spark.sparkContext.parallelize
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **b: jobs.append(1) or run(*a, **b))
    got = cluster.dendrogram(frame(spark, x), "average").orderBy("step").collect()
    assert [r["distance"] for r in got] == pytest.approx(want[:, 2], abs=1e-6) and got[-1]["size"] == len(x)
    assert len(jobs) < 12


@pytest.mark.parametrize("known", [40, 1 << 19])
def test_average_linkage_by_the_nearest_pairs(spark, monkeypatch, known):
    for name, value in (("AGGLOMERATIVE_MOST", 12), ("FEW", 0.0), ("KNOWN", known), ("LINKS", 1000), ("TILE", 500)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(15)
    x = np.vstack([rng.normal(c, 1.0, (60, 12)) for c in (0, 2)] + [np.full((30, 12), 1.0), rng.normal(5, 0.1, (40, 12))])
    ids, table = cluster._merged(frame(spark, x), "average", 12)
    want = cluster.merges(x, "average")
    assert table[:, 2] == pytest.approx(want[:, 2], abs=1e-6)
    for k in (2, 5, 15, 60):
        assert cluster.cut_tree(table, len(x), k).tolist() == cluster.cut_tree(want, len(x), k).tolist()


def test_more_rows_than_one_task_takes(spark, monkeypatch):
    monkeypatch.setattr(cluster, "AGGLOMERATIVE_MOST", 5)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(c, 0.5, (20, 2)) for c in ((0, 0), (9, 9), (-9, 9))])
    labels = [r["cluster_id"] for r in cluster.agglomerative(frame(spark, x), "average").orderBy("id").collect()]
    assert labels == [0] * 20 + [1] * 20 + [2] * 20
    assert cluster.dendrogram(frame(spark, x)).count() == 59


@pytest.mark.parametrize("name", ["f12_metadata", "j03_nested_lines"])
def test_a_test_without_lines_is_as_in_the_sql(spark, small, tmp_path, name):
    duck = duckdb.connect()
    for t in os.listdir(small):
        rows = "orders WHERE o_custkey <> (SELECT min(o_custkey) FROM orders)" if t == "orders.parquet" else t.removesuffix(".parquet")
        duck.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")
        duck.execute(f"COPY (SELECT * FROM {rows}) TO '{tmp_path}/{t}'")
        duck.execute(f"CREATE OR REPLACE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{t}'")
    df = catalog.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(want, key=repr)


def likeness(x, y):
    return len(set(x) & set(y)) / max(1, len(set(x) | set(y)))


def test_dense_prints_meet_by_blocks(spark, crowded):
    rng = np.random.default_rng(13)
    bits = [sorted(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) for _ in range(1200)] + [[]]
    bits[1100:1110] = [bits[0]] * 10
    prints = spark.createDataFrame(list(enumerate(bits)), "test_case_id long, bits array<int>")
    df = sketch.overlaps(prints, 0.5)
    assert not any("bit#" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    got = df.collect()
    first = {}
    reps = [i for i, x in enumerate(bits) if first.setdefault(tuple(x), i) == i]
    assert {(r["a"], r["b"]) for r in got if r["kind"] == "member"} == {(i, first[tuple(x)]) for i, x in enumerate(bits) if first[tuple(x)] != i}
    want = {(a, b): s for k, a in enumerate(reps) for b in reps[k + 1 :] if (s := likeness(bits[a], bits[b])) >= 0.5}
    assert {(r["a"], r["b"]): r["similarity"] for r in got if r["kind"] == "pair"} == want


def test_names_meet_by_blocks(spark, crowded):
    names = sorted({f"test_{i % 7}_{i % 11}_é{i % 600}" for i in range(1100)} | {"", "_", "x"})
    rows = spark.createDataFrame([(i % 2, n, list(dict.fromkeys(n.split("_")))) for i, n in enumerate(names)], "grp long, id string, v array<string>")
    got = {(r["grp"], r["a"], r["b"]): r["similarity"] for r in sketch.set_pairs(rows).collect()}
    want = {(g, a, b): likeness(a.split("_"), b.split("_")) for g in (0, 1) for i, a in enumerate(names[g::2]) for b in names[g::2][i + 1 :]}
    assert got == want


@pytest.fixture
def gathered_anew(spark):
    """Rows that come in another order on each reading, as from executors."""

    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield lambda df: df.mapInArrow(shuffled, df.schema)
    spark.conf.unset("spark.sql.exchange.reuse")


def test_a_block_meets_itself_in_one_order(spark, gathered_anew):
    names = [f"test_{i % 7}_{i % 11}_{'_'.join('abc'[: i % 4])}_{i}" for i in range(300)]
    rows = gathered_anew(spark.createDataFrame([(0, n, n.split("_")) for n in names], "grp long, id string, v array<string>").withColumn("v", F.array_distinct("v")))
    got = sorted((r["a"], r["b"], r["similarity"]) for r in sketch.set_pairs(rows).collect())
    assert got == sorted((min(a, b), max(a, b), likeness(a.split("_"), b.split("_"))) for k, a in enumerate(names) for b in names[:k])


def test_a_vector_is_not_its_own_neighbour_in_any_order(spark, gathered_anew):
    x = np.random.default_rng(14).normal(size=(700, 3))
    got = {r["id"]: r["score"] for r in pairs.nearest(gathered_anew(frame(spark, x)), 1, size=1000).collect()}
    d = distances(x) + np.diag(np.full(len(x), np.inf))
    assert [got[i] for i in range(len(x))] == pytest.approx(d.min(axis=1))


def test_name_similarity_joins_no_pairs_of_names(spark, small):
    plan = catalog.queries()["u06_name_similarity"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("cells", [tsne.CELLS, 0])
def test_tsne_of_more_rows_than_one_task_takes(spark, monkeypatch, cells):
    # on the grid, and with the repulsion of all pairs in the tasks
    x = np.vstack([np.random.default_rng(k).normal(size=(40, 5)) + 8 * k for k in range(3)])
    monkeypatch.setattr(reduce, "TSNE_MOST", 100)
    monkeypatch.setattr(tsne, "CELLS", cells)
    monkeypatch.setattr(tsne, "FAR", 2)
    run = lambda **k: [(r["id"], r["v"]) for r in reduce.tsne(frame(spark, x), **k).orderBy("id").collect()]
    # 30 perplexities' neighbours are a part of the rows, 40 all of them
    got = run(perplexity=30, rounds=60)
    assert [i for i, _ in got] == list(range(120)) and np.isfinite(np.array([v for _, v in got])).all()
    got = np.array([v for _, v in run(perplexity=40, rounds=12)])
    want = reduce._tsne(x, 2, 40, 12, 42)
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_tsne_grid_repels_as_all_pairs_do():
    for scale, bound in ((1e-4, 1e-9), (1, 1e-3), (8, 1e-2)):
        y = np.random.default_rng(0).normal(size=(3000, 2)) * scale
        y[:3] *= 100
        (got, total), (want, all_pairs) = tsne.Grid().push(y), tsne.push(y, y)
        assert tsne.far(y).sum() >= 3
        assert np.linalg.norm(got - want) < bound * np.linalg.norm(want) and total == pytest.approx(all_pairs, rel=1e-3)


def test_tsne_neighbours_of_copies():
    x = np.random.default_rng(0).normal(size=(500, 8))
    x[100:] = x[100]
    chosen = np.zeros(500, int)
    for rows, near, d in tsne.nearest(x, 0, 500, 16):
        assert near.shape == (len(rows), 16) and (near != rows[:, None]).all()
        assert all(len(set(n)) == 16 for n in near.tolist())
        want = np.sort(np.where(np.arange(500) == rows[:, None], np.inf, ((x[rows][:, None] - x) ** 2).sum(2)), axis=1)[:, :16]
        assert np.sort(d, axis=1) == pytest.approx(want, abs=1e-9)
        np.add.at(chosen, near[rows >= 100], 1)
    # none is the neighbour of most copies
    assert chosen[:100].sum() == 0 and chosen[100:].max() < 64

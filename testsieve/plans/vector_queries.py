"""Registered queries over vectors: similarities, cluster quality, clustering, reduction, entropy."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import cluster, entropy, findings, metrics, pairs, reduce
from ..operators.settle import settle
from .catalog import register
from .fixtures import ctes, load
from .store_queries import R, rounded

_V = ctes("vectors")
_PAIRS = _V + ", p AS (SELECT x.cluster_id AS grp, x.id AS a, y.id AS b, x.v AS va, y.v AS vb FROM vectors x JOIN vectors y USING (cluster_id) WHERE x.id < y.id) "
_ALL = _V + ", d AS (SELECT x.id AS i, x.cluster_id AS own, y.id AS j, y.cluster_id AS other, list_distance(x.v, y.v) AS d FROM vectors x, vectors y) "


def _vectors(spark, sf_dir, label="label"):
    return load(spark, sf_dir, "vectors").select("id", "v", F.col("cluster_id").alias(label))


def _grouped(spark, sf_dir):
    return _vectors(spark, sf_dir, "grp")


@register("m01_pairwise_cosine", _PAIRS + f"SELECT grp, a, b, {R('list_cosine_similarity(va, vb)')} AS score FROM p")
def m01(spark, sf_dir):
    return rounded(pairs.pair_scores(_grouped(spark, sf_dir)))


@register("m03_combined", _PAIRS + f"SELECT grp, a, b, {R('0.7e0 * list_cosine_similarity(va[1:32], vb[1:32]) + 0.3e0 * list_cosine_similarity(va[33:64], vb[33:64])')} AS score FROM p")
def m03(spark, sf_dir):
    return rounded(pairs.pair_scores(_grouped(spark, sf_dir), partial(pairs.combined_kernel, split=32)))


@register("m04_euclidean", _PAIRS + f"SELECT grp, a, b, {R('list_distance(va, vb)')} AS score FROM p")
def m04(spark, sf_dir):
    return rounded(pairs.pair_scores(_grouped(spark, sf_dir), pairs.euclidean_kernel))


def _long(df):
    return rounded(df.select("id", F.posexplode("v").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), "x"))


@register("m05_l2", _V + f", u AS (SELECT id, unnest(range(64)) AS k, unnest(v) AS x FROM vectors), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM u GROUP BY id) SELECT id, k, {R('x / greatest(n, 1e-12)')} AS x FROM u JOIN n USING (id)")
def m05(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("id", X.l2_normalize(F.col("v")).alias("v")))


@register("m06_minmax", _V + f", u AS (SELECT id, list_min(v) AS lo, list_max(v) AS hi, unnest(range(64)) AS k, unnest(v) AS x FROM vectors) SELECT id, k, {R('(x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END')} AS x FROM u")
def m06(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("id", X.min_max(F.col("v")).alias("v")))


@register("m07_standardize", _V + f", u AS (SELECT id, unnest(range(64)) AS k, unnest(v) AS x FROM vectors), s AS (SELECT id, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY id) SELECT id, k, {R('(x - m) / greatest(s, 1e-12)')} AS x FROM u JOIN s USING (id)")
def m07(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("id", X.standardize(F.col("v")).alias("v")))


@register("d06_standardized_columns", _V + f", u AS (SELECT id, unnest(range(64)) AS k, unnest(v) AS x FROM vectors), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY k) SELECT id, k, {R('(x - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END')} AS x FROM u JOIN s USING (k)")
def d06(spark, sf_dir):
    return _long(reduce.standardize(_vectors(spark, sf_dir)))


@register("m08_euclidean_similarity", _PAIRS + f", d AS (SELECT grp, a, b, list_distance(va, vb) AS d FROM p) SELECT grp, a, b, {R('1 - d / max(d) OVER (PARTITION BY grp)')} AS similarity FROM d")
def m08(spark, sf_dir):
    return rounded(metrics.similarity_matrix(_grouped(spark, sf_dir)))


@register("m11_threshold", _PAIRS + f"SELECT grp, {R('quantile_cont(list_cosine_similarity(va, vb), 0.9)')} AS threshold FROM p GROUP BY grp")
def m11(spark, sf_dir):
    return rounded(metrics.threshold(_grouped(spark, sf_dir)))


_SIL = _ALL + """, n AS (SELECT own, count(DISTINCT i) AS n FROM d GROUP BY own), s AS (SELECT i, own, other, sum(d) AS t, any_value(n.n) AS n FROM d JOIN n ON n.own = d.other GROUP BY i, d.own, other),
    ab AS (SELECT i, own, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM s GROUP BY ALL),
    sl AS (SELECT i, own, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab) """.replace("SELECT i, own, other, sum(d)", "SELECT i, d.own, other, sum(d)")


@register("m09_silhouette", _SIL + f"SELECT i AS id, own AS label, {R('s')} AS silhouette FROM sl")
def m09(spark, sf_dir):
    return rounded(metrics.silhouettes(_vectors(spark, sf_dir)).select("id", "label", "silhouette"))


_CENTERS = _V + ", u AS (SELECT id, cluster_id AS l, unnest(range(64)) AS k, unnest(v) AS x FROM vectors), c AS (SELECT l, k, avg(x) AS c, count(*) AS n FROM u GROUP BY ALL), g AS (SELECT k, avg(x) AS m FROM u GROUP BY k), "


@register(
    "m09_calinski_harabasz",
    _CENTERS
    + f"bt AS (SELECT sum(n * (c - m) * (c - m)) AS b FROM c JOIN g USING (k)), w AS (SELECT sum((x - c) * (x - c)) AS w FROM u JOIN c USING (l, k)), q AS (SELECT count(DISTINCT l) AS k, count(DISTINCT id) AS n FROM u) SELECT {R('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM bt, w, q",
)
def m09_ch(spark, sf_dir):
    return rounded(metrics.calinski_harabasz(_vectors(spark, sf_dir)))


@register(
    "m09_davies_bouldin",
    _CENTERS
    + f"dist AS (SELECT id, l, sqrt(sum((x - c) * (x - c))) AS d FROM u JOIN c USING (l, k) GROUP BY ALL), s AS (SELECT l, avg(d) AS s FROM dist GROUP BY l), cc AS (SELECT x.l AS a, y.l AS b, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS d FROM c x JOIN c y USING (k) WHERE x.l <> y.l GROUP BY ALL), "
    f"r AS (SELECT a, max((sa.s + sb.s) / d) AS r FROM cc JOIN s sa ON sa.l = a JOIN s sb ON sb.l = b GROUP BY a) SELECT {R('avg(r)')} AS davies_bouldin FROM r",
)
def m09_db(spark, sf_dir):
    return rounded(metrics.davies_bouldin(_vectors(spark, sf_dir)))


@register("m10_evaluate")
def m10(spark, sf_dir):
    """All scores at once, one label counting as noise."""
    rows = _vectors(spark, sf_dir)
    return rounded(metrics.evaluate(rows.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))))


@register("m12_cohesion", _ALL + f"SELECT own AS label, {R('avg(d)')} AS cohesion FROM d WHERE own = other AND i <> j GROUP BY own")
def m12(spark, sf_dir):
    return rounded(metrics.cohesion(_vectors(spark, sf_dir)))


@register("m13_separation", _ALL + f"SELECT own AS a, other AS b, {R('avg(d)')} AS separation FROM d WHERE own < other GROUP BY ALL")
def m13(spark, sf_dir):
    return rounded(metrics.separation(_vectors(spark, sf_dir)))


@register("m14_compactness", _ALL + f"SELECT own AS label, {R('avg(d)')} AS compactness, count(DISTINCT i) AS size FROM d WHERE own = other AND i <> j GROUP BY own")
def m14(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rounded(metrics.cohesion(rows).join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label").select("label", F.col("cohesion").alias("compactness"), "size"))


@register("w05_medoids", _ALL + ", t AS (SELECT i, own, round(sum(d), 9) AS t FROM d WHERE own = other GROUP BY ALL) SELECT own AS label, i AS medoid FROM t QUALIFY row_number() OVER (PARTITION BY own ORDER BY t, i) = 1")
def w05(spark, sf_dir):
    return metrics.medoids(_vectors(spark, sf_dir)).select("label", "medoid")


_SIGNS = "CASE WHEN v[1] > 0 THEN 2 ELSE 0 END + CASE WHEN v[2] > 0 THEN 1 ELSE 0 END"


@register(
    "m15_external",
    _V
    + f""", t AS (SELECT cluster_id AS a, {_SIGNS} AS b FROM vectors), n AS (SELECT a, b, count(*) * 1e0 AS n FROM t GROUP BY ALL), na AS (SELECT a, sum(n) AS na FROM n GROUP BY a), nb AS (SELECT b, sum(n) AS nb FROM n GROUP BY b), t0 AS (SELECT sum(n) AS t FROM n),
    h AS (SELECT (SELECT sum(-(na / t) * ln(na / t)) FROM na, t0) AS ha, (SELECT sum(-(nb / t) * ln(nb / t)) FROM nb, t0) AS hb, (SELECT sum(na * (na - 1) / 2) FROM na) AS ca, (SELECT sum(nb * (nb - 1) / 2) FROM nb) AS cb,
      (SELECT sum(n * (n - 1) / 2) FROM n) AS cn, (SELECT sum(-(n / t) * ln(n / nb)) FROM n JOIN nb USING (b), t0) AS ab, (SELECT sum(-(n / t) * ln(n / na)) FROM n JOIN na USING (a), t0) AS ba, (SELECT t * (t - 1) / 2 FROM t0) AS c2),
    s AS (SELECT (cn - ca * cb / c2) / ((ca + cb) / 2 - ca * cb / c2) AS ari, 1 - ab / ha AS h, 1 - ba / hb AS c FROM h)
    SELECT {R("ari")} AS ari, {R("h")} AS homogeneity, {R("c")} AS completeness, {R("2 * h * c / (h + c)")} AS v_measure FROM s""",
)
def m15(spark, sf_dir):
    found = F.when(F.element_at("v", 1) > 0, 2).otherwise(0) + F.when(F.element_at("v", 2) > 0, 1).otherwise(0)
    return rounded(metrics.agreement(_vectors(spark, sf_dir, "truth").select("truth", found.alias("found"))))


@register("m18_score", _PAIRS + f"SELECT grp AS cluster_id, {R('avg(list_cosine_similarity(va, vb))')} AS score FROM p GROUP BY grp")
def m18(spark, sf_dir):
    return rounded(pairs.pair_scores(_grouped(spark, sf_dir)).groupBy(F.col("grp").alias("cluster_id")).agg(F.avg("score").alias("score")))


_CL = _V + ", c AS (SELECT id, CASE WHEN cluster_id = 9 THEN -1 ELSE cluster_id END AS cluster_id FROM vectors), s AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) "


def _clusters(spark, sf_dir):
    return load(spark, sf_dir, "vectors").select("id", F.when(F.col("cluster_id") == 9, F.lit(-1)).otherwise(F.col("cluster_id")).alias("cluster_id"))


@register("a15_sizes", _CL + f"SELECT min(n) AS min_size, max(n) AS max_size, {R('avg(n)')} AS mean_size, {R('quantile_cont(n, 0.5)')} AS median_size, {R('stddev_pop(n)')} AS std_size, count(*) AS n_clusters FROM s WHERE cluster_id <> -1")
def a15(spark, sf_dir):
    return rounded(metrics.size_stats(_clusters(spark, sf_dir)))


@register("a16_noise", _CL + f"SELECT {R('coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n)')} AS noise_ratio, coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n) > 0.3 AS too_noisy, CAST(count(*) FILTER (cluster_id <> -1 AND n < 3) AS BIGINT) AS outlier_clusters FROM s")
def a16(spark, sf_dir):
    return rounded(metrics.noise_stats(_clusters(spark, sf_dir)))


@register("a17_hierarchy", "WITH s AS (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT count(*) AS n_clusters, max(n) AS max_size, min(n) AS min_size, (round(max(n) * 1e0 / greatest(min(n), 1), 6) + 0e0) AS imbalance, CAST(count(*) FILTER (n = 1) AS BIGINT) AS singletons, CAST(count(*) FILTER (n > 10) AS BIGINT) AS large FROM s")
def a17(spark, sf_dir):
    return rounded(metrics.hierarchy_stats(load(spark, sf_dir, "part").select(F.struct("p_size", "p_brand").alias("cluster_id"))))


@register(
    "a18_balance",
    "WITH s AS (SELECT p_size, p_brand, count(*) * 1e0 AS s FROM part GROUP BY ALL), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () * 1e0 AS n, sum(s) OVER () AS t FROM s) "
    f"SELECT {R('2 * sum(i * s) / (any_value(n) * any_value(t)) - (any_value(n) + 1) / any_value(n)')} AS gini, {R('sum(-(s / t) * log2(s / t + 1e-10)) / log2(any_value(n))')} AS entropy, {R('var_pop(s)')} AS variance, {R('stddev_pop(s) / avg(s)')} AS cv FROM r",
)
def a18(spark, sf_dir):
    return rounded(metrics.balance(load(spark, sf_dir, "part").select(F.struct("p_size", "p_brand").alias("cluster_id"))))


_KNN = _ALL + ", k AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d WHERE i <> j) "


@register("w04_k_distance", _KNN + f"SELECT i AS id, {R('d')} AS distance FROM k WHERE r = 4")
def w04(spark, sf_dir):
    return rounded(metrics.k_distances(_vectors(spark, sf_dir), 5))


_STATS = ", ".join([f"{R('min(d)')} AS min", f"{R('max(d)')} AS max", f"{R('avg(d)')} AS mean", f"{R('stddev_pop(d)')} AS std", *(f"{R(f'quantile_cont(d, {q / 100})')} AS p{q}" for q in (10, 25, 50, 75, 90))])


@register("a19_kdist", _KNN + f"SELECT {_STATS} FROM k WHERE r = 4")
def a19(spark, sf_dir):
    return rounded(metrics.distance_stats(metrics.k_distances(_vectors(spark, sf_dir), 5)))


@register("a20_density", _KNN + f"SELECT i AS id, {R('avg(d)')} AS mean_distance FROM k WHERE r <= 5 GROUP BY i")
def a20(spark, sf_dir):
    return rounded(metrics.density(_vectors(spark, sf_dir)))


@register("a21_distances", _ALL + f"SELECT {_STATS} FROM d WHERE i < j")
def a21(spark, sf_dir):
    return rounded(metrics.pair_distance_stats(_vectors(spark, sf_dir)))


@register("a25_unique_vectors", _V + "SELECT count(DISTINCT v[1:1]) AS first_values, count(DISTINCT v) AS vectors FROM vectors")
def a25(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.count_distinct(F.slice("v", 1, 1)).alias("first_values"), F.count_distinct("v").alias("vectors"))


EPS, MIN_SAMPLES = 1.15, 4


@register(
    "c03_dbscan",
    _V.replace("WITH", "WITH RECURSIVE", 1)
    + f""", e AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON list_distance(x.v, y.v) <= {EPS}), core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
    ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (SELECT id, id AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
    r AS (SELECT id, min(root) AS root FROM reach GROUP BY id), n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM r)), l AS (SELECT id, c FROM r JOIN n USING (root)),
    bd AS (SELECT e.a AS id, min(c) AS c FROM e JOIN l ON l.id = e.b GROUP BY e.a) SELECT v.id, CAST(coalesce(l.c, bd.c, -1) AS INT) AS cluster_id FROM vectors v LEFT JOIN l ON l.id = v.id LEFT JOIN bd ON bd.id = v.id""",
)
def c03(spark, sf_dir):
    return cluster.dbscan(_vectors(spark, sf_dir).select("id", "v"), EPS, MIN_SAMPLES)


@register("c04_eps")
def c04(spark, sf_dir):
    eps, how = cluster.best_eps(_vectors(spark, sf_dir).select("id", "v"), MIN_SAMPLES)
    return spark.createDataFrame([(eps, how)], "eps double, how string")


@register("c01_kmeans")
def c01(spark, sf_dir):
    return cluster.kmeans(_vectors(spark, sf_dir).select("id", "v"), 10)


@register("c02_best_k")
def c02(spark, sf_dir):
    return spark.createDataFrame([(cluster.best_k(_vectors(spark, sf_dir).select("id", "v")),)], "k long")


@register("c08_ward")
def c08(spark, sf_dir):
    return cluster.agglomerative(_vectors(spark, sf_dir).select("id", "v"), "ward", k=10)


@register("c09_best_cut")
def c09(spark, sf_dir):
    return cluster.agglomerative(_vectors(spark, sf_dir).select("id", "v"), "average")


@register("c10_dendrogram")
def c10(spark, sf_dir):
    return cluster.dendrogram(_vectors(spark, sf_dir).select("id", "v"))


@register("c11_cluster_members", _V + "SELECT cluster_id, string_agg(id, ',' ORDER BY id) AS members FROM vectors GROUP BY 1")
def c11(spark, sf_dir):
    members = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return load(spark, sf_dir, "vectors").groupBy("cluster_id").agg(members.alias("members"))


@register(
    "c07_cluster_structs",
    _ALL + f", t AS (SELECT own, i, round(sum(d), 9) AS t FROM d WHERE own = other GROUP BY ALL), m AS (SELECT own, i FROM t QUALIFY row_number() OVER (PARTITION BY own ORDER BY t, i) = 1), "
    f"c AS (SELECT own, avg(d) AS c, count(DISTINCT i) AS n FROM d WHERE own = other AND i <> j GROUP BY own) SELECT c.own AS label, m.i AS medoid, n AS size, {R('c')} AS compactness FROM c JOIN m USING (own)",
)
def c07(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return rounded(metrics.medoids(rows).join(metrics.cohesion(rows), "label").join(sizes, "label").select("label", "medoid", "size", F.col("cohesion").alias("compactness")))


@register(
    "c12_merge_small",
    "WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 7 THEN p_partkey + 100 ELSE p_size END AS cluster_id FROM part), s AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1), l AS (SELECT cluster_id AS l, n AS most FROM s ORDER BY n DESC, cluster_id LIMIT 1), "
    "t AS (SELECT cluster_id, CASE WHEN n < 2 AND most >= 2 THEN l ELSE cluster_id END AS target FROM s, l), k AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS number FROM (SELECT DISTINCT target FROM t)) SELECT id, number AS cluster_id FROM c JOIN t USING (cluster_id) JOIN k USING (target)",
)
def c12(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return cluster.merge_small(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 40 == 7, F.col("p_partkey") + 100).otherwise(F.col("p_size").cast("long")).alias("cluster_id")))


@register("d01_pca")
def d01(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", "v")
    return reduce.PCA(8).fit(rows).transform(rows)


@register("d03_random_projection")
def d03(spark, sf_dir):
    return reduce.random_projection(_vectors(spark, sf_dir).select("id", "v"), 64, 16)


@register("d02_tsne")
def d02(spark, sf_dir):
    return reduce.tsne(_vectors(spark, sf_dir).select("id", "v"), rounds=500)


def _parts(spark, sf_dir):
    v = load(spark, sf_dir, "vectors")
    return v.select("id", F.slice("v", 1, 32).alias("sem"), F.transform(F.slice("v", 33, 32), lambda x: (x > 0).cast("double")).alias("cov"))


_E = (
    _V
    + """, s AS (SELECT id, unnest(v[1:32]) AS x FROM vectors), m AS (SELECT id, sum(abs(x)) AS m FROM s GROUP BY id), se AS (SELECT id, sum(CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / m) * log2(abs(x) / m) END) / log2(32) AS h FROM s JOIN m USING (id) GROUP BY id),
    o AS (SELECT id, list_sum(list_transform(v[33:64], lambda x: CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END)) / 32 AS p FROM vectors), ce AS (SELECT id, CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END AS c FROM o),
    q AS (SELECT id, h, c, least(1, h / 0.5e0) AS sq, least(1, c / 0.85e0) AS cq FROM se JOIN ce USING (id)), qq AS (SELECT *, 0.7e0 * sq + 0.3e0 * cq AS o FROM q) """
)


@register("e01_entropy", _E + f"SELECT id, {R('h')} AS semantic_entropy, {R('c')} AS coverage_entropy FROM qq")
def e01(spark, sf_dir):
    return rounded(entropy.quality(_parts(spark, sf_dir)).select("id", "semantic_entropy", "coverage_entropy"))


@register("e02_quality", _E + f"SELECT id, {R('sq')} AS semantic_quality, {R('cq')} AS coverage_quality, {R('o')} AS overall, o < 0.5 AS low_quality, concat_ws(';', CASE WHEN h < 0.5 THEN 'low semantic entropy' END, CASE WHEN c < 0.85 THEN 'low coverage entropy' END) AS issues FROM qq")
def e02(spark, sf_dir):
    q = entropy.quality(_parts(spark, sf_dir))
    return rounded(q.select("id", "semantic_quality", "coverage_quality", "overall", "low_quality", F.array_join("issues", ";").alias("issues")))


@register(
    "e04_damping",
    _E + f", u AS (SELECT id, unnest(range(64)) AS k, unnest(v) AS x FROM vectors), d AS (SELECT u.id, k, x * CASE WHEN k < 32 THEN sq ELSE cq END AS x FROM u JOIN qq ON qq.id = u.id), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM d GROUP BY id) SELECT id, k, {R('x / greatest(n, 1e-12)')} AS x FROM d JOIN n USING (id)",
)
def e04(spark, sf_dir):
    w = entropy.quality(_parts(spark, sf_dir)).select("id", F.col("semantic_quality").alias("ws"), F.col("coverage_quality").alias("wc"))
    return _long(entropy.damp(_vectors(spark, sf_dir).select("id", "v"), w, 32))


def _agg(c: str, name: str) -> str:
    return ", ".join([f"{R(f'min({c})')} AS {name}_min", f"{R(f'max({c})')} AS {name}_max", f"{R(f'avg({c})')} AS {name}_mean", f"{R(f'stddev_pop({c})')} AS {name}_std"])


@register("a14_entropy_summary", _E + f"SELECT {_agg('h', 'semantic_entropy')}, {_agg('c', 'coverage_entropy')}, {_agg('o', 'overall')}, CAST(count(*) FILTER (o < 0.5) AS BIGINT) AS low_quality FROM qq")
def a14(spark, sf_dir):
    return rounded(entropy.summary(entropy.quality(_parts(spark, sf_dir))))


@register(
    "j04_combine_features",
    _V
    + f""", f AS (SELECT id, v[1:32] AS s, cluster_id < 7 AS hs, v[33:64] AS c, cluster_id > 2 AS hc FROM vectors), w AS (SELECT id, list_concat(CASE WHEN hs THEN s ELSE list_transform(range(32), lambda x: 0e0) END, CASE WHEN hc THEN c ELSE list_transform(range(32), lambda x: 0e0) END) AS v FROM f WHERE hs OR hc),
    u AS (SELECT id, unnest(range(64)) AS k, unnest(v) AS x FROM w), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM u GROUP BY id) SELECT id, k, {R("x / greatest(n, 1e-12)")} AS x FROM u JOIN n USING (id)""",
)
def j04(spark, sf_dir):
    v = load(spark, sf_dir, "vectors")
    sem = v.where("cluster_id < 7").select("id", F.slice("v", 1, 32).alias("v"))
    cov = v.where("cluster_id > 2").select("id", F.slice("v", 33, 32).alias("v"))
    return _long(entropy.combine(sem, cov, 32, 32))


# Cosines of these vectors are small, so the levels are set lower than the defaults.
LEVELS = {"very_high_redundancy": 0.4, "high_redundancy": 0.3, "moderate_redundancy": 0.2, "low_redundancy": 0.1}
_LEVEL = "CASE WHEN {0} >= 0.4 THEN 'very_high_redundancy' WHEN {0} >= 0.3 THEN 'high_redundancy' WHEN {0} >= 0.2 THEN 'moderate_redundancy' WHEN {0} >= 0.1 THEN 'low_redundancy' ELSE 'no_redundancy' END"
_SC = ctes("vectors", "tests", "dense") + ", p AS (SELECT x.cluster_id AS grp, x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM vectors x JOIN vectors y USING (cluster_id) WHERE x.id < y.id), bw AS (SELECT grp, a AS id, b AS other, s FROM p UNION ALL SELECT grp, b, a, s FROM p) "


def _members(spark, sf_dir):
    return load(spark, sf_dir, "vectors")


@register("r01_cluster_redundancy", _SC + f"SELECT grp AS cluster_id, count(*) AS pairs, {R('avg(s)')} AS mean_similarity, CAST(count(*) FILTER (s >= 0.2) AS BIGINT) AS redundant_pairs, {_LEVEL.format('avg(s)')} AS level FROM p GROUP BY grp")
def r01(spark, sf_dir):
    return rounded(findings.cluster_redundancy(findings.cluster_pairs(_members(spark, sf_dir)), LEVELS))


_R02 = _SC + f", n AS (SELECT grp, id, string_agg(other, ',' ORDER BY other) AS o, count(*) AS k, max(s) AS m FROM bw WHERE s >= 0.2 GROUP BY ALL), r AS (SELECT v.cluster_id, v.id, coalesce(o, '') AS similar_tests, coalesce(k, 0) AS similar_count, coalesce(m, 0) AS m, {_LEVEL.format('coalesce(m, 0)')} AS status FROM vectors v LEFT JOIN n ON n.grp = v.cluster_id AND n.id = v.id) "


def _redundant(spark, sf_dir):
    m = _members(spark, sf_dir)
    return findings.redundant_tests(m, findings.cluster_pairs(m, least=0.2), LEVELS)


@register("r02_redundant_tests", _R02 + f"SELECT cluster_id, id, similar_tests, {R('m')} AS max_similarity, status FROM r")
def r02(spark, sf_dir):
    from .store_queries import joined

    return rounded(_redundant(spark, sf_dir).select("cluster_id", "id", joined("similar_tests").alias("similar_tests"), "max_similarity", "status"))


@register("k04_csv_rows", _R02 + "SELECT id AS test, cluster_id, status, similar_count, concat(printf('%.1f', floor(m * 100 * 10 + 0.5e0) / 10), '%') AS max_similarity, replace(similar_tests, ',', '; ') AS similar_tests FROM r")
def k04(spark, sf_dir):
    return findings.csv_rows(_redundant(spark, sf_dir))


@register(
    "a12_summary",
    _R02 + f", l AS (SELECT * FROM (VALUES ('very_high_redundancy', true), ('high_redundancy', true), ('moderate_redundancy', true), ('low_redundancy', false), ('no_redundancy', false)) t(level, redundant)), c AS (SELECT status, count(*) AS n FROM r GROUP BY 1) "
    f"SELECT level, coalesce(n, 0) AS tests, {R('coalesce(n, 0) * 100e0 / (SELECT count(*) FROM r)')} AS percent, redundant FROM l LEFT JOIN c ON status = level",
)
def a12(spark, sf_dir):
    return rounded(findings.redundancy_summary(_redundant(spark, sf_dir)))


HIGH, MEDIUM = 0.4, 0.1
_FOUND = (
    _SC
    + f""", lc AS (SELECT test_case_id, count(*) AS n FROM dense GROUP BY 1), mb AS (SELECT v.cluster_id, v.id, exec_time_ms, coalesce(lc.n, 0) AS lines FROM vectors v LEFT JOIN tests t ON t.id = v.id LEFT JOIN lc ON lc.test_case_id = v.id),
    sm AS (SELECT grp, id, sum(s) AS s, count(*) AS n FROM bw GROUP BY ALL), sc AS (SELECT cluster_id, mb.id, round(0.7e0 * (s + 1) / n + 0.2e0 / (1 + coalesce(exec_time_ms, 0) / 1000) + 0.1e0 * lines / 100, 9) AS sc FROM mb JOIN sm ON sm.grp = cluster_id AND sm.id = mb.id),
    rp AS (SELECT cluster_id, id AS rep, sc FROM sc QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sc DESC, id) = 1), cl AS (SELECT cluster_id, other AS id, s FROM bw JOIN rp ON grp = cluster_id AND bw.id = rep WHERE s >= {MEDIUM}),
    ls AS (SELECT cl.cluster_id, cl.id, count(d.line) AS total, count(d.line) FILTER (k.line IS NULL) AS lost FROM cl JOIN rp USING (cluster_id) LEFT JOIN dense d ON d.test_case_id = cl.id LEFT JOIN dense k ON k.test_case_id = rep AND k.file = d.file AND k.line = d.line GROUP BY ALL),
    rd AS (SELECT ls.cluster_id, ls.id, exec_time_ms, lines FROM ls JOIN mb USING (cluster_id, id) WHERE total = 0 OR 1 - lost * 1e0 / total >= 0.95), pr AS (SELECT cluster_id, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, sum(coalesce(exec_time_ms, 0)) AS ms, CAST(sum(lines) AS BIGINT) AS lines FROM rd GROUP BY 1),
    sg AS (SELECT grp AS cluster_id, least(1, greatest(0, avg(s))) AS score FROM p GROUP BY 1),
    fd AS (SELECT rp.cluster_id, rep AS representative, coalesce(ids, '') AS redundant_tests, coalesce(n, 0) AS n, coalesce(lines, 0) AS lines, score, CASE WHEN score >= {HIGH} OR coalesce(n, 0) >= 10 THEN 'high' WHEN score >= {MEDIUM} OR coalesce(n, 0) >= 5 THEN 'medium' ELSE 'low' END AS priority, coalesce(ms, 0) AS ms FROM rp JOIN sg USING (cluster_id) LEFT JOIN pr USING (cluster_id)) """
)


def _finding_inputs(spark, sf_dir):
    from ..operators import store

    lines = load(spark, sf_dir, "dense")
    counts = store.line_counts(lines).withColumnRenamed("test_case_id", "id")
    tests = load(spark, sf_dir, "tests").select("id", "exec_time_ms")
    m = _members(spark, sf_dir).join(tests, "id", "left").join(counts, "id", "left")
    # pairs are used three times below; they are made once
    return m, settle(findings.cluster_pairs(m), "pairs"), lines


@register("w03_representatives", _FOUND + f"SELECT cluster_id, rep AS representative, {R('sc')} AS score FROM rp")
def w03(spark, sf_dir):
    m, p, _ = _finding_inputs(spark, sf_dir)
    return rounded(findings.representatives(m, p))


@register("r04_findings", _FOUND + f"SELECT cluster_id, representative, redundant_tests, {R('score')} AS score, priority, {R('ms / 1000e0')} AS seconds_saved FROM fd")
def r04(spark, sf_dir):
    from .store_queries import joined

    m, p, lines = _finding_inputs(spark, sf_dir)
    f = findings.findings(m, p, lines, HIGH, MEDIUM)
    return rounded(f.select("cluster_id", "representative", joined("redundant_tests").alias("redundant_tests"), "score", "priority", "seconds_saved"))


@register("k10_report_counts", _FOUND + "SELECT count(*) AS findings, CAST(count(*) FILTER (priority = 'high') AS BIGINT) AS high, CAST(count(*) FILTER (priority = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (priority = 'low') AS BIGINT) AS low, CAST(sum(n) AS BIGINT) AS redundant_tests FROM fd")
def k10(spark, sf_dir):
    m, p, lines = _finding_inputs(spark, sf_dir)
    return findings.report_counts(findings.findings(m, p, lines, HIGH, MEDIUM))


_FB = "fb AS (SELECT user_id AS cluster_id, CASE event_type WHEN 'error' THEN 'ignore' WHEN 'view' THEN 'keep' WHEN 'purchase' THEN 'merge' ELSE event_type END AS feedback FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) "


@register(
    "r08_recommendations",
    _FOUND
    + f""", {_FB} SELECT cluster_id, representative, CASE WHEN score >= 0.95 THEN 'merge' WHEN score >= 0.85 THEN 'consolidate' WHEN score >= 0.7 THEN 'review' ELSE 'monitor' END AS action, CASE WHEN feedback IN ('keep', 'ignore') THEN 'none' WHEN feedback = 'merge' THEN 'high' ELSE priority END AS severity,
    {R("CASE WHEN feedback IN ('keep', 'ignore') THEN 0 ELSE CASE priority WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 10 END + score * 20 + least(n * 2, 20) + least(ms / 1000e0 / 100, 10) END")} AS priority, {R("ms")} AS time_saved_ms, lines AS lines_reduction, n AS test_count_reduction,
    {R("n / (n + 1e0) * 100")} AS percentage_reduction, feedback FROM fd LEFT JOIN fb USING (cluster_id)""",
)
def r08(spark, sf_dir):
    from ..operators import store

    m, p, lines = _finding_inputs(spark, sf_dir)
    f = findings.findings(m, p, lines, HIGH, MEDIUM)
    rec = findings.recommendations(f, store.latest_feedback(load(spark, sf_dir, "feedback")), m.select("id", "exec_time_ms", "lines_covered"))
    return rounded(rec.drop("impact", "rationale"))

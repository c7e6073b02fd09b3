"""Quality of clusterings: silhouette, variance ratios, external agreement, sizes, balance and distances.

rows(id, v array<double>, label). Noise is label -1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import cosine_kernel, euclidean_kernel, hot_sums, label_sums, nearest, pair_quantiles, pair_scores

NOISE = -1
PERCENTILES = (10, 25, 50, 75, 90)


def silhouettes(rows: DataFrame) -> DataFrame:
    """(id, label, a, b, silhouette) of every row: exact, by sums of distances to whole clusters; 0 alone in a cluster."""
    sums = label_sums(rows)
    own = F.col("own") == F.col("other")
    s = sums.groupBy("id", "own").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    return s.select("id", F.col("own").alias("label"), "a", "b", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def mean_silhouettes(rows: DataFrame, labels: list[str]) -> list[float | None]:
    """The mean silhouette of each of several labellings, columns of few labels from 0, by one pass over the pairs. The driver holds
    the sizes of the clusters."""
    if not labels:
        return []
    counted = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(c).cast("int").alias("l")) for t, c in enumerate(labels)])).alias("x")).groupBy("x").count().collect()
    sizes = sorted((r["x"]["t"], r["x"]["l"], r["count"]) for r in counted)
    place = {(t, c): k for k, (t, c, _) in enumerate(sizes)}
    sums = hot_sums(rows, [F.map_from_arrays(F.array(*[F.lit(c) for u, c, _ in sizes if u == t]), F.array(*[F.lit(k) for (u, _), k in place.items() if u == t]))[F.col(name).cast("int")] for t, name in enumerate(labels)], len(sizes))
    means = []
    for t in range(len(labels)):
        own = [(F.col(f"k{t}") == place[u, c], F.col(f"s{place[u, c]}"), n) for u, c, n in sizes if u == t]
        a, b = F.lit(None).cast("double"), F.least(*[F.when(~at, s / n) for at, s, n in own], F.lit(None), F.lit(None))
        for at, s, n in own:
            a = F.when(at & F.lit(n > 1), s / max(n - 1, 1)).otherwise(a)
        means.append(F.avg(F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b))))
    return list(sums.agg(*means).first())


def _centroids(rows: DataFrame) -> DataFrame:
    """(label, n, c): the mean vector of each cluster."""
    parts = rows.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(_square(a, b))


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """One row: the ratio of dispersion between and within clusters, by their degrees of freedom."""
    centers = _centroids(rows)
    whole = _centroids(rows.withColumn("label", F.lit(0))).select(F.col("c").alias("m"), F.col("n").alias("total"))
    between = centers.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * _square(F.col("c"), F.col("m"))).alias("between"), F.count(F.lit(1)).alias("k"), F.max("total").alias("total"))
    within = rows.join(F.broadcast(centers), "label").agg(F.sum(_square(F.col("v"), F.col("c"))).alias("within"))
    return between.crossJoin(within).select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of spreads to the distance of centers. Pairs are of clusters."""
    centers = _centroids(rows)
    spread = rows.join(F.broadcast(centers), "label").groupBy("label").agg(F.avg(_distance(F.col("v"), F.col("c"))).alias("s"))
    c = centers.join(spread, "label").select("label", "c", "s")
    other = c.select(F.col("label").alias("other"), F.col("c").alias("oc"), F.col("s").alias("os"))
    ratio = (F.col("s") + F.col("os")) / _distance(F.col("c"), F.col("oc"))
    worst = c.join(F.broadcast(other), F.col("label") != F.col("other")).groupBy("label").agg(F.max(ratio).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def evaluate(rows: DataFrame) -> DataFrame:
    """One row: clusters, noise, and the three scores over what isn't noise; null where there are too few or too many clusters."""
    kept = rows.where(F.col("label") != NOISE)
    counts = rows.agg(F.count_distinct(F.when(F.col("label") != NOISE, F.col("label"))).alias("n_clusters"), F.sum((F.col("label") == NOISE).cast("long")).alias("n_noise"), F.count(F.lit(1)).alias("n"))
    s = silhouettes(kept).agg(F.avg("silhouette").alias("silhouette"))
    out = counts.crossJoin(s).crossJoin(calinski_harabasz(kept)).crossJoin(davies_bouldin(kept))
    ok = (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n") - F.col("n_noise"))
    return out.select("n_clusters", "n_noise", *[F.when(ok, F.col(c)).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")])


def similarity_matrix(rows: DataFrame) -> DataFrame:
    """rows(grp, id, v) -> (grp, a, b, similarity): 1 - distance / the group's largest distance; 1 where all are equal."""
    d = pair_scores(rows, euclidean_kernel)
    most = d.groupBy("grp").agg(F.max("score").alias("most"))
    return d.join(F.broadcast(most), "grp").select("grp", "a", "b", F.when(F.col("most") > 0, 1 - F.col("score") / F.col("most")).otherwise(1.0).alias("similarity"))


def threshold(rows: DataFrame, share: float = 0.9, kernel: Callable = cosine_kernel) -> DataFrame:
    """rows(grp, id, v) -> (grp, threshold): an exact percentile of the scores of a group's pairs, without a row for each pair."""
    return pair_quantiles(rows, kernel, [share]).select("grp", F.col("quantiles")[0].alias("threshold"))


def cohesion(rows: DataFrame) -> DataFrame:
    """(label, cohesion): the mean distance of pairs within a cluster, 0 for one row. From sums, without pairs."""
    sums = label_sums(rows).where("own = other")
    n, total = F.sum(F.lit(1)), F.sum("total")
    return sums.groupBy(F.col("own").alias("label")).agg(F.when(n < 2, 0.0).otherwise(total / (n * (n - 1))).alias("cohesion"))


def separation(rows: DataFrame) -> DataFrame:
    """(a, b, separation): the mean distance between the rows of two clusters, a < b."""
    sums = label_sums(rows).where("own < other")
    return sums.groupBy(F.col("own").alias("a"), F.col("other").alias("b")).agg((F.sum("total") / F.sum("n")).alias("separation"))


def medoids(rows: DataFrame) -> DataFrame:
    """(label, medoid, total): the row of least summed distance to its cluster; ties go to the smallest id."""
    sums = label_sums(rows).where("own = other")
    # sums are compared after rounding, so that equal ones tie whatever the order of addition was
    best = sums.groupBy(F.col("own").alias("label")).agg(F.min(F.struct(F.round("total", 9).alias("total"), "id")).alias("m"))
    return best.select("label", F.col("m.id").alias("medoid"), F.col("m.total").alias("total"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs(truth, found) of all rows -> one row: adjusted Rand index, homogeneity, completeness, V-measure (= normalized
    mutual information with arithmetic mean). All from the contingency table, whose size is that of the label sets."""
    table = pairs.groupBy("truth", "found").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = table.groupBy("truth").agg(F.sum("n").alias("na"))
    b = table.groupBy("found").agg(F.sum("n").alias("nb"))
    total = table.agg(F.sum("n").alias("t"))
    t, two = F.col("t"), lambda c: F.col(c) * (F.col(c) - 1) / 2
    ha = a.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col("na") / t) * F.log(F.col("na") / t)).alias("ha"), F.sum(two("na")).alias("ca"))
    hb = b.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col("nb") / t) * F.log(F.col("nb") / t)).alias("hb"), F.sum(two("nb")).alias("cb"))
    met = table.join(a, "truth").join(b, "found").crossJoin(F.broadcast(total))
    both = met.agg(F.sum(-(F.col("n") / t) * F.log(F.col("n") / F.col("nb"))).alias("a_given_b"), F.sum(-(F.col("n") / t) * F.log(F.col("n") / F.col("na"))).alias("b_given_a"), F.sum(two("n")).alias("cn"), F.max("t").alias("t"))
    s = ha.crossJoin(hb).crossJoin(both)
    expected = F.col("ca") * F.col("cb") / two("t")
    s = s.withColumn("ari", (F.col("cn") - expected) / ((F.col("ca") + F.col("cb")) / 2 - expected))
    s = s.withColumn("homogeneity", F.when(F.col("ha") == 0, 1.0).otherwise(1 - F.col("a_given_b") / F.col("ha")))
    s = s.withColumn("completeness", F.when(F.col("hb") == 0, 1.0).otherwise(1 - F.col("b_given_a") / F.col("hb")))
    h, c = F.col("homogeneity"), F.col("completeness")
    return s.select("ari", "homogeneity", "completeness", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)).alias("v_measure"))


def size_stats(clusters: DataFrame) -> DataFrame:
    """clusters(cluster_id) of all rows -> one row of statistics over the sizes, without noise."""
    sizes = clusters.where(F.col("cluster_id") != NOISE).groupBy("cluster_id").count()
    n = F.col("count").cast("double")
    return sizes.agg(F.min("count").alias("min_size"), F.max("count").alias("max_size"), F.avg(n).alias("mean_size"), F.percentile(n, 0.5).alias("median_size"), F.stddev_pop(n).alias("std_size"), F.count(F.lit(1)).alias("n_clusters"))


def noise_stats(clusters: DataFrame, small: int = 3) -> DataFrame:
    """One row: noise ratio, whether that is too much, clusters of fewer than `small` rows."""
    sizes = clusters.groupBy("cluster_id").count()
    noise = F.coalesce(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("count"))), F.lit(0))
    ratio = noise / F.sum("count")
    return sizes.agg(ratio.alias("noise_ratio"), (ratio > 0.3).alias("too_noisy"), F.sum(((F.col("cluster_id") != NOISE) & (F.col("count") < small)).cast("long")).alias("outlier_clusters"))


def hierarchy_stats(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").count()
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.max("count").alias("max_size"), F.min("count").alias("min_size"), (F.max("count") / F.greatest(F.min("count"), F.lit(1))).alias("imbalance"),
        F.sum((F.col("count") == 1).cast("long")).alias("singletons"), F.sum((F.col("count") > 10).cast("long")).alias("large"),
    )


def balance(clusters: DataFrame) -> DataFrame:
    """One row: Gini index, normalized entropy, variance and coefficient of variation of the sizes. The ranks are over
    distinct sizes, with their multiplicity, so the window sees few rows however many clusters there are."""
    sizes = clusters.groupBy("cluster_id").count().groupBy(F.col("count").alias("s")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("before", before)
    # the ranks before + 1 .. before + m add up to m * before + m (m + 1) / 2
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    sums = ranked.agg(F.sum(ranks * F.col("s")).alias("rs"), F.sum(F.col("m") * F.col("s")).cast("double").alias("total"), F.sum("m").cast("double").alias("n"), F.sum(F.col("m") * F.col("s") * F.col("s")).cast("double").alias("sq"))
    p = F.col("s") / F.col("total")
    entropy = sizes.crossJoin(F.broadcast(sums.select("total"))).agg(F.sum(-F.col("m") * p * F.log2(p + 1e-10)).alias("h"))
    n, total = F.col("n"), F.col("total")
    var = F.col("sq") / n - (total / n) * (total / n)
    return sums.crossJoin(entropy).select(
        (2 * F.col("rs") / (n * total) - (n + 1) / n).alias("gini"), F.when(n > 1, F.col("h") / F.log2(n)).otherwise(0.0).alias("entropy"), var.alias("variance"), (F.sqrt(var) / (total / n)).alias("cv")
    )


def k_distances(rows: DataFrame, k: int) -> DataFrame:
    """(id, distance): of each row the distance to its k-th nearest, itself being the first."""
    if k <= 1:
        return rows.select("id", F.lit(0.0).alias("distance"))
    return nearest(rows, k - 1).where(F.col("place") == k - 1).select("id", F.col("score").alias("distance"))


def pair_distance_stats(rows: DataFrame) -> DataFrame:
    """rows(id, v) -> one row as distance_stats(), over the distances of all pairs; nulls without a pair."""
    s = pair_quantiles(rows.select(F.lit(0).cast("long").alias("grp"), "id", "v"), euclidean_kernel, [q / 100 for q in PERCENTILES])
    columns = {c: F.col(c) for c in ("min", "max", "mean", "std")} | {f"p{q}": F.col("quantiles")[i] for i, q in enumerate(PERCENTILES)}
    return s.agg(*[F.max(c).alias(name) for name, c in columns.items()])


def distance_stats(distances: DataFrame) -> DataFrame:
    d = F.col("distance")
    p = [F.percentile(d, q / 100).alias(f"p{q}") for q in PERCENTILES]
    return distances.agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), *p)


def density(rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, mean_distance) to the k nearest others."""
    return nearest(rows, k).groupBy("id").agg(F.avg("score").alias("mean_distance"))


def sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, the same ones on every run: those whose ids hash lowest."""
    return rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)

"""Redundancy of tests within clusters, findings, recommendations and feedback.

members(cluster_id, id, v); pairs come from operators.pairs as (grp, a, b, score) with a < b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scoring as S
from ..functions.vectors import jaccard
from .pairs import cosine_kernel, pair_scores

MODERATE = S.LEVELS["moderate_redundancy"]


def cluster_pairs(members: DataFrame, kernel=cosine_kernel, least: float | None = None) -> DataFrame:
    return pair_scores(members.select(F.col("cluster_id").alias("grp"), "id", "v"), kernel, least)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(grp, id, other, score): each pair seen from either side."""
    return pairs.select("grp", F.col("a").alias("id"), F.col("b").alias("other"), "score").union(pairs.select("grp", F.col("b").alias("id"), F.col("a").alias("other"), "score"))


def cluster_redundancy(pairs: DataFrame, levels: dict[str, float] = S.LEVELS) -> DataFrame:
    """(cluster_id, pairs, mean_similarity, redundant_pairs, level) of clusters of two or more."""
    moderate = levels["moderate_redundancy"]
    out = pairs.groupBy(F.col("grp").alias("cluster_id")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("score").alias("mean_similarity"), F.sum((F.col("score") >= moderate).cast("long")).alias("redundant_pairs"))
    return out.withColumn("level", S.level(F.col("mean_similarity"), levels))


def redundant_tests(members: DataFrame, pairs: DataFrame, levels: dict[str, float] = S.LEVELS, include_noise: bool = True) -> DataFrame:
    """(cluster_id, id, similar_tests, max_similarity, status) of every test in a cluster of two or more: those at least
    moderately similar to it, and the level of the most similar among them."""
    near = both_ways(pairs.where(F.col("score") >= levels["moderate_redundancy"])).groupBy("grp", "id").agg(F.array_sort(F.collect_list("other")).alias("similar_tests"), F.max("score").alias("max_similarity"))
    large = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = members.select("cluster_id", "id").join(large, "cluster_id", "left_semi")
    kept = kept if include_noise else kept.where("cluster_id <> -1")
    out = kept.join(near.withColumnRenamed("grp", "cluster_id"), ["cluster_id", "id"], "left")
    best = F.coalesce("max_similarity", F.lit(0.0))
    return out.select("cluster_id", "id", F.coalesce("similar_tests", F.array().cast("array<bigint>")).alias("similar_tests"), best.alias("max_similarity"), S.level(best, levels).alias("status"))


def redundancy_summary(tests: DataFrame) -> DataFrame:
    """tests(status) -> (level, tests, percent, redundant): all levels, also those without tests. Levels are five rows."""
    spark = tests.sparkSession
    levels = spark.createDataFrame([(name, i <= 2) for i, name in enumerate(S.ALL_LEVELS)], "level string, redundant boolean")
    counts = tests.groupBy(F.col("status").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = levels.join(F.broadcast(counts), "level", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("level", n.alias("tests"), F.when(F.col("total") > 0, n / F.col("total") * 100).otherwise(0.0).alias("percent"), "redundant")


def representatives(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members(cluster_id, id, exec_time_ms, lines_covered): of each cluster of two or more the test of the best score (mean
    similarity, itself included, by the number of others; speed; coverage); ties go to the smallest id."""
    sums = both_ways(pairs).groupBy("grp", "id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    met = members.join(sums.withColumnRenamed("grp", "cluster_id"), ["cluster_id", "id"])
    score = 0.7 * (F.col("s") + 1) / F.col("n") + 0.2 / (1 + F.coalesce("exec_time_ms", F.lit(0.0)) / 1000) + 0.1 * F.coalesce("lines_covered", F.lit(0)) / 100
    # rounded, so that equal scores tie whatever the order of addition was
    best = met.groupBy("cluster_id").agg(F.max_by(F.struct("id"), F.struct(F.round(score, 9), -F.col("id"))).alias("m"), F.max(F.round(score, 9)).alias("score"))
    return best.select("cluster_id", F.col("m.id").alias("representative"), "score")


def preserved(candidate: Column, representative: Column, least: float = 0.95) -> Column:
    """Whether the representative covers enough of the candidate's lines."""
    lost = F.size(F.filter(candidate, lambda x: ~F.array_contains(representative, x)))
    return F.when(F.size(candidate) == 0, True).otherwise(1 - lost / F.size(candidate) >= least)


def lost_lines(reps: DataFrame, members: DataFrame, lines: DataFrame) -> DataFrame:
    """(cluster_id, id, total, lost): of each member its lines and how many of them the representative doesn't cover. By joins
    of lines, so tests of very many lines need no arrays."""
    met = members.select("cluster_id", "id").join(reps.select("cluster_id", "representative"), "cluster_id").where("id <> representative")
    own = met.join(lines.select(F.col("test_case_id").alias("id"), "file", "line"), "id", "left")
    rep = reps.join(lines.withColumnRenamed("test_case_id", "representative"), "representative").select("cluster_id", "file", "line", F.lit(True).alias("kept"))
    out = own.join(rep, ["cluster_id", "file", "line"], "left")
    return out.groupBy("cluster_id", "id").agg(F.count("line").alias("total"), F.sum((F.col("line").isNotNull() & F.col("kept").isNull()).cast("long")).alias("lost"))


def findings(members: DataFrame, pairs: DataFrame, lines: DataFrame, high: float = S.HIGH, medium: float = S.MEDIUM) -> DataFrame:
    """One row per cluster of two or more: representative, redundant tests, score, priority, text, time saved."""
    reps = representatives(members, pairs)
    rep_pairs = both_ways(pairs).join(reps.select(F.col("cluster_id").alias("grp"), F.col("representative").alias("id")), ["grp", "id"]).select(F.col("grp").alias("cluster_id"), F.col("other").alias("id"), "score")
    close = rep_pairs.where(F.col("score") >= medium)
    lost = lost_lines(reps, close.select("cluster_id", "id"), lines)
    redundant = close.join(lost, ["cluster_id", "id"]).where("total = 0 or 1 - lost / total >= 0.95")
    redundant = redundant.join(members.select("cluster_id", "id", "exec_time_ms"), ["cluster_id", "id"])
    per = redundant.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("redundant_tests"), F.sum(F.coalesce("exec_time_ms", F.lit(0.0))).alias("ms"), F.count(F.lit(1)).alias("n"))
    score = pairs.groupBy(F.col("grp").alias("cluster_id")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("score"))).alias("score"))
    out = reps.select("cluster_id", "representative").join(score, "cluster_id").join(per, "cluster_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "cluster_id",
        "representative",
        F.coalesce("redundant_tests", F.array().cast("array<bigint>")).alias("redundant_tests"),
        F.col("score"),
        S.priority(F.col("score"), n, high, medium).alias("priority"),
        S.recommendation(F.col("score"), n, high, medium).alias("recommendation"),
        (F.coalesce("ms", F.lit(0.0)) / 1000).alias("seconds_saved"),
    )


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(S.priority_rank(F.col("priority")), F.desc("score"), "cluster_id")


def overlap_percent(members: DataFrame, lines: DataFrame, first: int = 10) -> DataFrame:
    """(cluster_id, overlap): the mean Jaccard similarity, in percent, of the line sets of a cluster's first ten tests (by id)
    that have lines. The limit is the operator's own: at most 45 pairs per cluster."""
    lead = members.select("cluster_id", "id").withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).where(F.col("r") <= first)
    sets = lines.groupBy(F.col("test_case_id").alias("id")).agg(F.collect_set(F.struct("file", "line")).alias("ls"))
    met = lead.join(sets, "id")
    a, b = met.select("cluster_id", F.col("id").alias("a"), F.col("ls").alias("x")), met.select("cluster_id", F.col("id").alias("b"), F.col("ls").alias("y"))
    return a.join(b, "cluster_id").where("a < b").groupBy("cluster_id").agg((F.avg(jaccard(F.col("x"), F.col("y"))) * 100).alias("overlap"))


def recommendations(found: DataFrame, feedback: DataFrame, details: DataFrame) -> DataFrame:
    """findings() with actions, numeric priorities, grounds and savings, after the latest feedback: `keep` and `ignore` take a
    finding out (severity none, priority 0), `merge` makes it high. details(id, exec_time_ms, lines_covered)."""
    saved = found.select("cluster_id", F.explode("redundant_tests").alias("id")).join(details, "id", "left").groupBy("cluster_id").agg(
        F.sum(F.coalesce("exec_time_ms", F.lit(0.0))).alias("time_saved_ms"), F.sum(F.coalesce("lines_covered", F.lit(0))).alias("lines_reduction")
    )
    n = F.size("redundant_tests")
    out = found.join(saved, "cluster_id", "left").join(feedback.select("cluster_id", F.col("action").alias("feedback")), "cluster_id", "left")
    out = out.withColumn("number", S.numeric_priority(F.col("priority"), F.col("score"), n, F.col("seconds_saved")))
    none = F.coalesce(F.col("feedback").isin("keep", "ignore"), F.lit(False))
    return out.select(
        "cluster_id",
        "representative",
        S.action(F.col("score")).alias("action"),
        S.impact(F.col("score")).alias("impact"),
        F.when(none, "none").when(F.col("feedback") == "merge", "high").otherwise(F.col("priority")).alias("severity"),
        F.when(none, 0.0).otherwise(F.col("number")).alias("priority"),
        F.coalesce("time_saved_ms", F.lit(0.0)).alias("time_saved_ms"),
        F.coalesce("lines_reduction", F.lit(0)).alias("lines_reduction"),
        n.cast("long").alias("test_count_reduction"),
        (n / (n + 1) * 100).alias("percentage_reduction"),
        S.rationale(F.col("score"), n, F.col("seconds_saved"), F.lit(0.0)).alias("rationale"),
        "feedback",
    )


def report_counts(found: DataFrame) -> DataFrame:
    """One row: findings by priority, redundant tests."""
    def count(p: str) -> Column:
        return F.coalesce(F.sum((F.col("priority") == p).cast("long")), F.lit(0)).alias(p)

    return found.agg(F.count(F.lit(1)).alias("findings"), count("high"), count("medium"), count("low"), F.coalesce(F.sum(F.size("redundant_tests")), F.lit(0)).alias("redundant_tests"))


def csv_rows(tests: DataFrame) -> DataFrame:
    """redundant_tests() as the rows of the CSV report."""
    return tests.select(
        F.col("id").alias("test"), "cluster_id", "status", F.size("similar_tests").cast("long").alias("similar_count"), F.concat(S.one_decimal(F.col("max_similarity") * 100), F.lit("%")).alias("max_similarity"),
        F.array_join(F.transform("similar_tests", lambda x: x.cast("string")), "; ").alias("similar_tests"),
    )


def cluster_csv_rows(members: DataFrame, sem: DataFrame, cov: DataFrame, both: DataFrame, levels: dict[str, float] = S.LEVELS) -> DataFrame:
    """The rows of the cluster summary report: size, mean similarities (percent) of three sets of pairs, level, tests."""
    def mean(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy(F.col("grp").alias("cluster_id")).agg(F.avg("score").alias(name))

    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), "; ").alias("tests"))
    out = sizes.join(mean(sem, "s"), "cluster_id", "left").join(mean(cov, "c"), "cluster_id", "left").join(mean(both, "b"), "cluster_id", "left").fillna(0.0, ["s", "c", "b"])
    percent = lambda c: F.concat(S.one_decimal(F.col(c) * 100), F.lit("%"))
    return out.select(
        "cluster_id", "size", percent("s").alias("avg_semantic_similarity"), percent("c").alias("avg_coverage_similarity"), percent("b").alias("avg_combined_similarity"), S.level(F.col("b"), levels).alias("redundancy_level"), "tests"
    )


def result_totals(found: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: redundant tests, their share of all tests in percent, findings of high priority."""
    totals = found.agg(F.coalesce(F.sum(F.size("redundant_tests")), F.lit(0)).alias("redundant"), F.coalesce(F.sum((F.col("priority") == "high").cast("long")), F.lit(0)).alias("high_priority"))
    n = tests.agg(F.count(F.lit(1)).alias("n"))
    return totals.crossJoin(n).select("redundant", F.when(F.col("n") == 0, 0.0).otherwise(F.col("redundant") / F.col("n") * 100).alias("reduction_percent"), "high_priority")

"""Safety rules that keep tests of opposing purpose apart. names(cluster_id, name), each name once per cluster.

Rules look at names; equal names are one, and pairs are compared only between a rule's two sides within a cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.vectors import jaccard
from .settle import settle

# Words of a test's purpose and the expression of its opposite.
OPPOSITES = [
    ("success", "fail|failure|error|exception"), ("valid", "invalid"), ("empty", "notempty|not_empty"), ("null", "notnull|not_null"),
    ("authorized", "unauthorized|forbidden"), ("authenticated", "unauthenticated|guest"), ("create", "delete|destroy|remove"),
    ("add", "remove|delete"), ("enable", "disable"), ("start", "stop|end"), ("show", "hide"), ("open", "close"), ("accept", "reject|deny"),
    ("allow", "block|prevent"), ("connect", "disconnect"), ("login", "logout"), ("subscribe", "unsubscribe"), ("lock", "unlock"),
    ("activate", "deactivate"), ("online", "offline"), ("available", "unavailable"), ("public", "private"), ("visible", "hidden|invisible"),
]
BOUNDARY = "min|minimum|max|maximum|zero|empty|boundary|edge|limit|overflow|underflow"
EXCEPTION = "exception|error|fail|throw|throws|raising|invalid|malformed|corrupt"

# Words of intent and of the opposite intent, and what a name asserts.
INTENTS = [
    ("success", "fail|failure|error|exception"), ("valid", "invalid"), ("empty", "notempty|not_empty"), ("null", "notnull|not_null"),
    ("true", "false"), ("found", "notfound|not_found|missing"), ("exists", "not_exists|doesnt_exist|missing"), ("authorized", "unauthorized|forbidden"),
    ("create|created", "delete|deleted|destroy"), ("with", "without"), ("before", "after"), ("ascending|asc", "descending|desc"),
    ("min|minimum", "max|maximum"), ("first", "last"), ("single", "multiple|many"), ("enabled", "disabled"), ("active", "inactive|expired"),
    ("online", "offline"), ("cached|cache_hit", "uncached|cache_miss"), ("sync|synchronous", "async|asynchronous"),
]
ASSERTIONS = {
    "throws_exception": "throw|exception|expectexception", "returns_null": "return.*null|null.*return", "returns_empty": "return.*empty|empty.*return",
    "http_success": "assert(ok|success|200)", "http_error": r"assert(error|fail|4[0-9][0-9]|5[0-9][0-9])",
}
BOUNDARY_WORDS = ["min", "max", "edge", "boundary", "limit"]

SAFE, SMALL = "safe", "small"


def _sides(name: Column) -> Column:
    """(rule, side) of every rule that a name matches: 0 its word, 1 its opposite's expression."""
    low, out = F.lower(name), []
    for i, (word, opposite) in enumerate(OPPOSITES):
        out.append(F.when(F.contains(low, F.lit(word)), F.struct(F.lit(i).alias("rule"), F.lit(0).alias("side"))))
        out.append(F.when(F.rlike(low, F.lit(opposite)), F.struct(F.lit(i).alias("rule"), F.lit(1).alias("side"))))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def _alike(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(F.split(F.lower(a), "_")), F.array_distinct(F.split(F.lower(b), "_"))) > 0.8


def opposing(names: DataFrame) -> DataFrame:
    """(cluster_id, a, b, rule) of names of a cluster that oppose each other by a rule, a on the word's side: only the two
    sides of a rule meet, and very similar names don't count."""
    sided = names.distinct().select("cluster_id", "name", F.explode(_sides(F.col("name"))).alias("s")).select("cluster_id", "name", "s.rule", "s.side")
    a = sided.where("side = 0").select("cluster_id", "rule", F.col("name").alias("a"))
    b = sided.where("side = 1").select("cluster_id", "rule", F.col("name").alias("b"))
    return a.join(b, ["cluster_id", "rule"]).where((F.col("a") != F.col("b")) & ~_alike(F.col("a"), F.col("b"))).select("cluster_id", "a", "b", "rule")


def cluster_safety(names: DataFrame) -> DataFrame:
    """(cluster_id, n, is_safe, reason): two or fewer tests are safe; else mixed exception handling, then more than 30 %
    boundary tests, then an opposing pair make a cluster unsafe."""
    low = F.lower("name")
    exception, boundary = F.rlike(low, F.lit(EXCEPTION)), F.rlike(low, F.lit(BOUNDARY))
    facts = names.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max(exception).alias("some"), F.min(exception).alias("all"), F.sum(boundary.cast("long")).alias("edges"))
    pairs = opposing(names).select("cluster_id").distinct().withColumn("opposed", F.lit(True))
    f = facts.join(pairs, "cluster_id", "left")
    reason = (
        F.when(F.col("n") <= 2, SMALL)
        .when(F.col("some") & ~F.col("all"), "mixed_exception")
        .when(F.col("edges") > F.col("n") * 0.3, "boundary")
        .when(F.col("opposed"), "opposing")
        .otherwise(SAFE)
    )
    return f.select("cluster_id", "n", reason.isin(SAFE, SMALL).alias("is_safe"), reason.alias("reason"))


def split_opposing(names: DataFrame) -> DataFrame:
    """(cluster_id, sub, name): greedy groups; each takes the smallest name left and all that don't oppose it. The rules are
    matched once a name; a group then costs one pass over bits, and words are compared only of names that oppose by a rule."""
    low = F.lower("name")

    def bits(match) -> Column:
        return F.array_compact(F.array(*[F.when(match(*rule), F.lit(i)) for i, rule in enumerate(OPPOSITES)]))

    matched = names.select("cluster_id", "name").distinct().select("cluster_id", "name", bits(lambda w, o: F.contains(low, F.lit(w))).alias("words"), bits(lambda w, o: F.rlike(low, F.lit(o))).alias("opposites"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        name, low = pdf["name"].to_numpy(), [set(n.lower().split("_")) for n in pdf["name"]]
        w, o = (np.array([sum(1 << int(i) for i in bits) for bits in pdf[c]], np.int64) for c in ("words", "opposites"))
        left, sub = np.arange(len(name)), np.zeros(len(name), np.int64)
        k = 0
        while len(left):
            seed = left[0]
            against = ((w[seed] & o[left]) | (o[seed] & w[left])) != 0
            for j in np.flatnonzero(against):
                x, y = low[seed], low[left[j]]
                against[j] = len(x & y) / len(x | y) <= 0.8
            sub[left[~against]] = k
            left, k = left[against], k + 1
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].to_numpy(), "sub": sub, "name": name})

    return matched.groupBy("cluster_id").applyInPandas(split, "cluster_id long, sub long, name string")


def split_unsafe(names: DataFrame) -> DataFrame:
    """(cluster_id, name) after unsafe clusters were split: parts of one name go, the others take new ids from the largest on,
    in the order of cluster and part. Also the rule-based step of the pipeline."""
    unsafe = cluster_safety(names).where("not is_safe").select("cluster_id")
    parts = split_opposing(names.join(unsafe, "cluster_id", "left_semi"))
    sizes = parts.groupBy("cluster_id", "sub").agg(F.count(F.lit(1)).alias("n"))
    most = names.agg(F.max("cluster_id").alias("most"))
    number = sizes.crossJoin(F.broadcast(most)).withColumn("new_id", F.col("most") + F.row_number().over(Window.orderBy("cluster_id", "sub"))).where("n >= 2")
    fresh = parts.join(number.select("cluster_id", "sub", "new_id"), ["cluster_id", "sub"]).select(F.col("new_id").alias("cluster_id"), "name")
    return names.join(unsafe, "cluster_id", "left_anti").select("cluster_id", "name").union(fresh)


def _boundaries(pattern: str, whole_words: bool) -> str:
    return f"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])" if whole_words else f"({pattern})"


def intent(name: Column) -> Column:
    """map of intent words found in a name: true for a word, false for its opposite; assertions are true."""
    low, entries = F.lower(name), []
    for word, opposite in INTENTS:
        for pattern, flag in ((word, True), (opposite, False)):
            found = F.regexp_extract(low, _boundaries(pattern, True), 1)
            entries.append(F.when(found != "", F.struct(found.alias("k"), F.lit(flag).alias("v"))))
    for key, pattern in ASSERTIONS.items():
        entries.append(F.when(F.rlike(low, F.lit(pattern)), F.struct(F.lit(key).alias("k"), F.lit(True).alias("v"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    # of equal words the last stands
    none = F.create_map().cast("map<string,boolean>")
    return F.aggregate(found, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))


def intent_conflicts(names: DataFrame, strict: bool = True, boundary_merging: bool = False) -> DataFrame:
    """(cluster_id, a, b, reason) of names of a cluster, a < b, whose intents conflict. The names of each kind are met with
    those of the other kind of its rule, not all with all."""
    # names are short and their intents are used by every rule below
    each = names.distinct().withColumn("intent", intent(F.col("name")))
    low = F.lower("name")
    edge = F.lit(False)
    for w in BOUNDARY_WORDS:
        edge = edge | F.contains(low, F.lit(w))
    each = settle(each.withColumn("edge", edge), "intents")
    flags = each.select("cluster_id", "name", F.explode("intent").alias("k", "v"))

    def side(kind: str) -> DataFrame:
        return flags.where(F.col("k") == kind).select("cluster_id", "name")

    def met(a: DataFrame, b: DataFrame, rank: int, reason: str) -> DataFrame:
        # the rule reads from the earlier name to the later one
        return a.withColumnRenamed("name", "a").join(b.withColumnRenamed("name", "b"), "cluster_id").where("a < b").select("cluster_id", "a", "b", F.struct(F.lit(rank).alias("rank"), F.lit(reason).alias("reason")).alias("r"))

    direct = flags.where("v").select("cluster_id", "k", F.col("name").alias("x")).join(flags.where("not v").select("cluster_id", "k", F.col("name").alias("y")), ["cluster_id", "k"])
    direct = direct.select("cluster_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.struct(F.lit(0).alias("rank"), F.lit("opposing intents").alias("reason")).alias("r")).where("a < b")
    out = direct.union(met(side("throws_exception"), side("http_success"), 1, "exception vs success")).union(met(side("http_error"), side("http_success"), 2, "error vs success"))
    if strict and not boundary_merging:
        edges = each.where("edge").select("cluster_id", "name")
        out = out.union(met(edges, edges, 3, "different boundary tests"))
    return out.groupBy("cluster_id", "a", "b").agg(F.min("r").alias("r")).select("cluster_id", "a", "b", F.col("r.reason").alias("reason"))


def category(name: Column) -> Column:
    keys = F.map_keys(intent(name))

    def has(*parts: str) -> Column:
        return F.exists(keys, lambda k: F.rlike(k, F.lit("|".join(parts))))

    return F.when(has("success", "valid"), "positive").when(has("fail", "error", "invalid"), "negative").when(F.rlike(F.lower(name), F.lit("boundary|edge")), "boundary").otherwise("neutral")


def semantic_split(names: DataFrame, strict: bool = True) -> DataFrame:
    """(cluster_id, name, original): clusters with conflicting intents become one cluster per category, numbered from the
    largest id on in the order of cluster and category."""
    unsafe = intent_conflicts(names, strict).select("cluster_id").distinct()
    bad = names.join(unsafe, "cluster_id", "left_semi").select("cluster_id", "name").withColumn("category", category(F.col("name")))
    most = names.agg(F.max("cluster_id").alias("most"))
    number = bad.select("cluster_id", "category").distinct().crossJoin(F.broadcast(most)).withColumn("new_id", F.col("most") + F.row_number().over(Window.orderBy("cluster_id", "category")))
    fresh = bad.join(number, ["cluster_id", "category"]).select(F.col("new_id").alias("cluster_id"), "name", F.col("cluster_id").alias("original"))
    return names.join(unsafe, "cluster_id", "left_anti").select("cluster_id", "name", F.col("cluster_id").alias("original")).union(fresh)


def validation_summary(safety: DataFrame) -> DataFrame:
    """One row over cluster_safety(): clusters, safe and unsafe ones, and the safe share in percent (100 without clusters)."""
    n = F.count(F.lit(1))
    safe = F.coalesce(F.sum(F.col("is_safe").cast("long")), F.lit(0))
    return safety.agg(n.alias("total"), safe.alias("safe"), (n - safe).alias("unsafe"), F.when(n == 0, 100.0).otherwise(safe / n * 100).alias("safety_rate"))


def reasons(safety: DataFrame) -> DataFrame:
    return safety.groupBy("reason").agg(F.count(F.lit(1)).alias("clusters"))

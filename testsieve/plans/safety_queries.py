"""Registered queries of the safety rules. The SQL side is built from the same rule lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import safety
from .catalog import register
from .fixtures import ctes, load
from .store_queries import R, rounded
from .text_queries import _q

_N = ctes("names") + ", n AS (SELECT DISTINCT cluster_id, name, lower(name) AS low FROM names)"
_RULES = ", rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(w)}, {_q(o)})" for i, (w, o) in enumerate(safety.OPPOSITES)) + ") t(rule, word, opposite))"
_ALIKE = "len(list_intersect(string_split({0}, '_'), string_split({1}, '_'))) * 1e0 / len(list_distinct(list_concat(string_split({0}, '_'), string_split({1}, '_')))) > 0.8"
_OPP = _N + _RULES + f", a AS (SELECT cluster_id, rule, name, low FROM n JOIN rules ON contains(low, word)), b AS (SELECT cluster_id, rule, name, low FROM n JOIN rules ON regexp_matches(low, opposite)), opp AS (SELECT a.cluster_id, a.name AS a, b.name AS b, a.rule FROM a JOIN b USING (cluster_id, rule) WHERE a.name <> b.name AND NOT ({_ALIKE.format('a.low', 'b.low')}))"


def _names(spark, sf_dir):
    return load(spark, sf_dir, "names").select("cluster_id", "name")


@register("q02_opposing", _OPP + " SELECT cluster_id, a, b, CAST(rule AS INT) AS rule FROM opp")
def q02(spark, sf_dir):
    return safety.opposing(_names(spark, sf_dir))


_SAFE = (
    _OPP
    + f""", f AS (SELECT cluster_id, count(*) AS n, bool_or(regexp_matches(lower(name), {_q(safety.EXCEPTION)})) AS any_e, bool_and(regexp_matches(lower(name), {_q(safety.EXCEPTION)})) AS all_e, count(*) FILTER (regexp_matches(lower(name), {_q(safety.BOUNDARY)})) AS edges FROM names GROUP BY 1),
    r AS (SELECT cluster_id, n, CASE WHEN n <= 2 THEN 'small' WHEN any_e AND NOT all_e THEN 'mixed_exception' WHEN edges > n * 0.3 THEN 'boundary' WHEN cluster_id IN (SELECT cluster_id FROM opp) THEN 'opposing' ELSE 'safe' END AS reason FROM f) """
)


@register("q01_safety", _SAFE + "SELECT cluster_id, n, reason IN ('safe', 'small') AS is_safe, reason FROM r")
def q01(spark, sf_dir):
    return safety.cluster_safety(_names(spark, sf_dir))


@register("a13_validation_summary", _SAFE + f"SELECT count(*) AS total, CAST(count(*) FILTER (reason IN ('safe', 'small')) AS BIGINT) AS safe, CAST(count(*) FILTER (reason NOT IN ('safe', 'small')) AS BIGINT) AS unsafe, {R("count(*) FILTER (reason IN ('safe', 'small')) * 100e0 / count(*)")} AS safety_rate FROM r")
def a13(spark, sf_dir):
    return rounded(safety.validation_summary(safety.cluster_safety(_names(spark, sf_dir))))


@register("a13_reasons", _SAFE + "SELECT reason, count(*) AS clusters FROM r GROUP BY reason")
def a13_reasons(spark, sf_dir):
    return safety.reasons(safety.cluster_safety(_names(spark, sf_dir)))


def _word(p: str) -> str:
    return rf"\b({p})\b"


_ENTRIES = " UNION ALL ".join(
    [f"SELECT cluster_id, name, {i} AS i, regexp_extract(low, {_q(_word(p))}, 1) AS k, {flag} AS v FROM n WHERE regexp_matches(low, {_q(_word(p))})" for i, (p, flag) in enumerate((p, flag) for w, o in safety.INTENTS for p, flag in ((w, "true"), (o, "false")))]
    + [f"SELECT cluster_id, name, {100 + i}, {_q(k)}, true FROM n WHERE regexp_matches(low, {_q(p)})" for i, (k, p) in enumerate(safety.ASSERTIONS.items())]
)
_INTENT = _N + f", e AS ({_ENTRIES}), it AS (SELECT cluster_id, name, k, arg_max(v, i) AS v FROM e GROUP BY ALL)"


@register("q07_intent", _INTENT + " SELECT cluster_id, name, k, v FROM it")
def q07(spark, sf_dir):
    return _names(spark, sf_dir).distinct().select("cluster_id", "name", F.explode(safety.intent(F.col("name"))).alias("k", "v"))


_EDGE = " OR ".join(f"contains(low, {_q(w)})" for w in safety.BOUNDARY_WORDS)
_CONF = (
    _INTENT
    + f""", pr AS (SELECT x.cluster_id, x.name AS a, y.name AS b, ({_EDGE.replace('low', 'x.low')}) AND ({_EDGE.replace('low', 'y.low')}) AS edge FROM n x JOIN n y USING (cluster_id) WHERE x.name < y.name),
    cf AS (SELECT cluster_id, a, b, CASE WHEN EXISTS (SELECT 1 FROM it p JOIN it q USING (cluster_id, k) WHERE p.cluster_id = pr.cluster_id AND p.name = a AND q.name = b AND p.v <> q.v) THEN 'opposing intents'
      WHEN EXISTS (SELECT 1 FROM it p WHERE p.cluster_id = pr.cluster_id AND p.name = a AND p.k = 'throws_exception') AND EXISTS (SELECT 1 FROM it q WHERE q.cluster_id = pr.cluster_id AND q.name = b AND q.k = 'http_success') THEN 'exception vs success'
      WHEN EXISTS (SELECT 1 FROM it p WHERE p.cluster_id = pr.cluster_id AND p.name = a AND p.k = 'http_error') AND EXISTS (SELECT 1 FROM it q WHERE q.cluster_id = pr.cluster_id AND q.name = b AND q.k = 'http_success') THEN 'error vs success'
      WHEN edge THEN 'different boundary tests' END AS reason FROM pr), ok AS (SELECT * FROM cf WHERE reason IS NOT NULL)"""
)


@register("q08_conflicts", _CONF + " SELECT cluster_id, a, b, reason FROM ok")
def q08(spark, sf_dir):
    return safety.intent_conflicts(_names(spark, sf_dir))


@register(
    "q09_categories",
    _INTENT
    + ", ks AS (SELECT cluster_id, name, bool_or(contains(k, 'success') OR contains(k, 'valid')) AS pos, bool_or(contains(k, 'fail') OR contains(k, 'error') OR contains(k, 'invalid')) AS neg FROM it GROUP BY ALL) SELECT n.cluster_id, n.name, CASE WHEN pos THEN 'positive' WHEN neg THEN 'negative' WHEN contains(low, 'boundary') OR contains(low, 'edge') THEN 'boundary' ELSE 'neutral' END AS category FROM n LEFT JOIN ks ON ks.cluster_id = n.cluster_id AND ks.name = n.name",
)
def q09(spark, sf_dir):
    return _names(spark, sf_dir).distinct().select("cluster_id", "name", safety.category(F.col("name")).alias("category"))


@register(
    "q10_semantic_split",
    _CONF
    + ", ks AS (SELECT cluster_id, name, bool_or(contains(k, 'success') OR contains(k, 'valid')) AS pos, bool_or(contains(k, 'fail') OR contains(k, 'error') OR contains(k, 'invalid')) AS neg FROM it GROUP BY ALL), "
    "ct AS (SELECT n.cluster_id, n.name, CASE WHEN pos THEN 'positive' WHEN neg THEN 'negative' WHEN contains(low, 'boundary') OR contains(low, 'edge') THEN 'boundary' ELSE 'neutral' END AS c FROM n LEFT JOIN ks ON ks.cluster_id = n.cluster_id AND ks.name = n.name WHERE n.cluster_id IN (SELECT cluster_id FROM ok)), "
    "nm AS (SELECT cluster_id, c, (SELECT max(cluster_id) FROM names) + row_number() OVER (ORDER BY cluster_id, c) AS new_id FROM (SELECT DISTINCT cluster_id, c FROM ct)) "
    "SELECT new_id AS cluster_id, ct.name, ct.cluster_id AS original FROM ct JOIN nm ON nm.cluster_id = ct.cluster_id AND nm.c = ct.c UNION ALL SELECT cluster_id, name, cluster_id FROM n WHERE cluster_id NOT IN (SELECT cluster_id FROM ok)",
)
def q10(spark, sf_dir):
    return safety.semantic_split(_names(spark, sf_dir).distinct())


def _against(seed: str, x: str) -> str:
    rules = " OR ".join(f"(contains(lower({a}), {_q(w)}) AND regexp_matches(lower({b}), {_q(o)}))" for w, o in safety.OPPOSITES for a, b in ((seed, x), (x, seed)))
    return f"(NOT ({_ALIKE.format(f'lower({seed})', f'lower({x})')}) AND ({rules}))"


def _greedy(source: str) -> str:
    """Each step of a cluster takes its smallest name left and all that don't oppose it."""
    step = "SELECT cluster_id, {sub} AS sub, list_filter({l}, lambda x: NOT {own}) AS grp, list_filter({l}, lambda x: {own}) AS rest FROM {t}"
    parts = [step.format(sub=sub, l=names, t=table, own=_against(f"{names}[1]", "x")) for sub, names, table in (("0", "l", "gl"), ("sub + 1", "rest", "gs WHERE len(rest) > 0"))]
    return f", gl AS (SELECT cluster_id, list_sort(list(DISTINCT name)) AS l FROM {source} GROUP BY 1), gs AS ({parts[0]} UNION ALL {parts[1]}), parts AS (SELECT cluster_id, CAST(sub AS BIGINT) AS sub, unnest(grp) AS name FROM gs) "


@register("q05_greedy_split", _N.replace("WITH ", "WITH RECURSIVE ", 1) + _greedy("names") + "SELECT cluster_id, sub, name FROM parts")
def q05(spark, sf_dir):
    return safety.split_opposing(_names(spark, sf_dir))


_UNSAFE = _SAFE.replace("FROM names GROUP BY 1)", "FROM n GROUP BY 1)").replace("WITH ", "WITH RECURSIVE ", 1) + ", un AS (SELECT n.cluster_id, n.name FROM n JOIN r USING (cluster_id) WHERE reason NOT IN ('safe', 'small'))"


@register(
    "q11_split_unsafe",
    _UNSAFE
    + _greedy("un")
    + ", nw AS (SELECT cluster_id, sub, count(*) AS size, row_number() OVER (ORDER BY cluster_id, sub) + (SELECT max(cluster_id) FROM n) AS new_id FROM parts GROUP BY cluster_id, sub) "
    "SELECT new_id AS cluster_id, name FROM parts JOIN nw USING (cluster_id, sub) WHERE size >= 2 UNION ALL SELECT cluster_id, name FROM n WHERE cluster_id IN (SELECT cluster_id FROM r WHERE reason IN ('safe', 'small'))",
)
def q11(spark, sf_dir):
    return safety.split_unsafe(_names(spark, sf_dir).distinct())

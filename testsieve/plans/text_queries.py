"""Registered queries over source text: tokens, vocabularies, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sketch, tfidf
from .catalog import register
from .fixtures import ctes, load
from .store_queries import _IDF, R, joined, rounded


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _strip(c: str) -> str:
    for p in (r"(?m)//.*?$", r"(?s)/\*.*?\*/", r"(?m)#.*?$"):
        c = f"regexp_replace({c}, {_q(p)}, '', 'g')"
    return c


def _raw(c: str) -> str:
    def every(p: str, g: int) -> str:
        return f"regexp_extract_all({c}, {_q(p)}, {g})"

    classes = f"list_filter({every('class[ \\t\\n\\f\\r]+([A-Za-z0-9_]+)', 1)}, lambda t: NOT regexp_matches(t, '^.*Test(Case|Duplicate)?$'))"
    parts = [
        every(r"function[ \t\n\f\r]+([A-Za-z0-9_]+)", 1), classes, every(r"->([A-Za-z0-9_]+)[ \t\n\f\r]*\(", 1), every(r"(?i)assert[A-Za-z0-9_]*", 0),
        every(r"(?i)\b(test|expect|mock|stub|spy|fake|fixture|teardown|setup)[A-Za-z0-9_]*", 1), every(r"\$([a-zA-Z_][A-Za-z0-9_]{2,})", 1), every(r"[\"']([^\"']{3,})[\"']", 1),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def _split(c: str) -> str:
    camel = r"string_split(trim(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '[ \t\n\f\r\v]+', ' ', 'g')), ' ')"
    return f"list_filter(flatten(list_transform({c}, lambda t: list_concat(list_concat([t], {camel}), string_split(t, '_')))), lambda t: length(t) > 1)"


def _tokens(c: str) -> str:
    return f"list_filter(list_transform({_split(_raw(_strip(c)))}, lambda t: lower(t)), lambda t: NOT list_contains({_list(T.STOP_WORDS)}, t))"


_SOURCES = "snippets", "terms"
_BOTH = ctes(*_SOURCES) + ", b AS (SELECT id, source FROM snippets UNION ALL SELECT -1 - id, source FROM terms) "


def _both(spark, sf_dir):
    terms = load(spark, sf_dir, "terms")
    return load(spark, sf_dir, "snippets").select("id", "source").union(terms.select((-1 - F.col("id")).alias("id"), "source"))


@register("f01_strip_comments", _BOTH + f"SELECT id, length(x) AS n, md5(x) AS digest FROM (SELECT id, {_strip('source')} AS x FROM b)")
def f01(spark, sf_dir):
    x = T.strip_comments(F.col("source"))
    return _both(spark, sf_dir).select("id", x.alias("x")).select("id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@register("f02_tokens", _BOTH + f"SELECT id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT id, {_raw('source')} AS x FROM b)")
def f02(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.raw_tokens(F.col("source")).alias("x")).select("id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


@register("f03_split_tokens", ctes("data_sets") + f"SELECT id, array_to_string({_split('string_split(name, chr(58))')}, '|') AS tokens FROM data_sets")
def f03(spark, sf_dir):
    return load(spark, sf_dir, "data_sets").select("id", F.array_join(T.split_tokens(F.split("name", ":")), "|").alias("tokens"))


@register("f04_tokenize", _BOTH + f"SELECT id, CAST(len(x) AS BIGINT) AS n, array_to_string(x, '|') AS tokens FROM (SELECT id, {_tokens('source')} AS x FROM b)")
def f04(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.tokenize(F.col("source")).alias("x")).select("id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("tokens"))


_NAMES = [r"([^/\\]+)(?:Test)?\.php$", "::([A-Za-z0-9_]+)$", "#([A-Za-z0-9_]+)$", "@([A-Za-z0-9_]+)$"]


@register("f05_test_name", ctes("paths") + "SELECT id, coalesce(" + ", ".join(f"nullif(regexp_extract(path, {_q(p)}, 1), '')" for p in _NAMES) + r", nullif(regexp_replace(string_split_regex(path, '[/\\:#@]')[-1], '\.php$', ''), '')) AS name FROM paths")
def f05(spark, sf_dir):
    return load(spark, sf_dir, "paths").select("id", T.test_name(F.col("path")).alias("name"))


def _normal(c: str) -> str:
    for p, by in ((r"(?s)/\*.*?\*/", ""), (r"(?m)//.*?$", ""), ('"[^"]*"', '""'), ("'[^']*'", "''"), (r"[ \t\n\f\r\v]+", " ")):
        c = f"regexp_replace({c}, {_q(p)}, {_q(by)}, 'g')"
    return c


@register("f06_normalize_code", _BOTH + f"SELECT id, md5({_normal('source')}) AS digest FROM b")
def f06(spark, sf_dir):
    return _both(spark, sf_dir).select("id", F.md5(T.normalize_code(F.col("source"))).alias("digest"))


_CODE = (
    f"list_filter(list_transform(regexp_extract_all(x, '[A-Za-z0-9_]+'), lambda w: CASE WHEN list_contains({_list(T.LANGUAGE_WORDS + T.TEST_WORDS)}, lower(w)) THEN lower(w) WHEN list_contains(c, w) THEN concat('call_', lower(w)) "
    "WHEN contains(lower(w), 'assert') OR contains(lower(w), 'expect') THEN lower(w) WHEN regexp_matches(w, '^[A-Z][a-zA-Z0-9]*$') THEN concat('class_', lower(w)) "
    "WHEN regexp_matches(lower(w), '^(password|user|admin|member|email|name|id|status|type|result|response|request)$') THEN lower(w) WHEN regexp_matches(w, '^([0-9]+|[0-9]+[eE][0-9]+)$') THEN 'num' END), lambda t: t IS NOT NULL)"
)


@register("f07_code_tokens", _BOTH + f", n AS (SELECT id, {_normal('source')} AS x FROM b), c AS (SELECT id, x, regexp_extract_all(x, '([A-Za-z0-9_]+)[ \\t\\n\\f\\r]*\\(', 1) AS c FROM n) SELECT id, array_to_string({_CODE}, ' ') AS tokens FROM c")
def f07(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.normalize_code(F.col("source")).alias("x")).select("id", F.array_join(T.code_tokens(F.col("x")), " ").alias("tokens"))


@register("s16_method_body", ctes("snippets") + r", m AS (SELECT id, concat('public function test_', lower(p_type), '_price(') AS head, source FROM snippets JOIN part ON p_partkey = id), r AS (SELECT id, substr(source, instr(source, head)) AS rest FROM m) SELECT id, length(rest) - length('}') - 1 AS n, md5(substr(rest, 1, length(rest) - 2)) AS digest FROM r")
def s16(spark, sf_dir):
    s = load(spark, sf_dir, "snippets").join(load(spark, sf_dir, "part"), F.col("id") == F.col("p_partkey"))
    body = T.method_body(F.col("source"), F.concat(F.lit("test_"), F.lower("p_type"), F.lit("_price")))
    return s.select("id", body.alias("x")).select("id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


_DOCS = ctes("terms") + ", d AS MATERIALIZED (SELECT id, regexp_extract_all(lower(source), '[a-z]+') AS tokens FROM terms), w AS (SELECT id, unnest(tokens) AS term FROM d), c AS MATERIALIZED (SELECT id, term, count(*) AS n FROM w GROUP BY ALL), "
_VOCAB = (
    "t AS (SELECT count(*) AS docs FROM d), f AS (SELECT term, count(*) AS df, any_value(docs) AS docs FROM c, t GROUP BY term), k AS (SELECT * FROM f WHERE df >= floor(0.01e0 * docs) AND df <= floor(0.95e0 * docs) ORDER BY df DESC, term LIMIT 5000), "
    "v AS MATERIALIZED (SELECT term, df, ln(docs * 1e0 / df) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS idx FROM k) "
)


def _docs(spark, sf_dir):
    docs = load(spark, sf_dir, "terms").select("id", F.regexp_extract_all(F.lower("source"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return docs, tfidf.term_counts(docs)


@register("v01_vocabulary", _DOCS + _VOCAB + f"SELECT term, df, {R('idf')} AS idf, idx FROM v")
def v01(spark, sf_dir):
    docs, counts = _docs(spark, sf_dir)
    return rounded(tfidf.vocabulary(counts, docs))


@register("v02_tfidf", _DOCS + _VOCAB + f"SELECT id, idx, {R('(1 + ln(n)) * idf')} AS value FROM c JOIN v USING (term)")
def v02(spark, sf_dir):
    docs, counts = _docs(spark, sf_dir)
    return rounded(tfidf.transform(counts, tfidf.vocabulary(counts, docs)))


@register("v03_feature_names", _DOCS + _VOCAB + "SELECT idx, term FROM v")
def v03(spark, sf_dir):
    docs, counts = _docs(spark, sf_dir)
    return tfidf.vocabulary(counts, docs).select("idx", "term")


@register("v05_projection")
def v05(spark, sf_dir):
    docs, counts = _docs(spark, sf_dir)
    vocab = tfidf.vocabulary(counts, docs).persist()
    return tfidf.project(spark, tfidf.transform(counts, vocab), docs.select("id"), vocab.count(), 32)


@register(
    "v06_tfidf_code",
    _DOCS
    + f"""t AS (SELECT count(*) AS docs FROM d), k AS (SELECT term, sum(n) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 768),
    v AS (SELECT term, ln(docs * 1e0 / df) AS idf, row_number() OVER (ORDER BY term) - 1 AS idx FROM k, t), r AS (SELECT c.id, idx, n * 1e0 / len(tokens) * idf AS x FROM c JOIN v USING (term) JOIN d ON d.id = c.id),
    m AS (SELECT id, sqrt(sum(x * x)) AS norm FROM r GROUP BY id) SELECT id, idx, {R("CASE WHEN norm > 0 THEN x / norm ELSE 0 END")} AS value FROM r JOIN m USING (id) WHERE idx < 384""",
)
def v06(spark, sf_dir):
    docs, counts = _docs(spark, sf_dir)
    return rounded(tfidf.code_vectors(counts, docs))


_BITS = ctes("dense") + ", b AS (SELECT DISTINCT test_case_id, CAST(concat('0x', right(sha256(concat(file, ':', line, ':42:', i)), 3)) AS INT) % 512 AS bit FROM dense, range(3) r(i)) "


@register("b02_bloom", _BITS + "SELECT test_case_id, string_agg(bit, ',' ORDER BY bit) AS bits FROM b GROUP BY 1")
def b02(spark, sf_dir):
    return sketch.bloom(load(spark, sf_dir, "dense")).select("test_case_id", joined("bits").alias("bits"))


@register("b04_density", _BITS + f"SELECT test_case_id, {R('count(*) / 512e0')} AS density FROM b GROUP BY 1")
def b04(spark, sf_dir):
    return rounded(sketch.density(sketch.bloom(load(spark, sf_dir, "dense"))))


@register(
    "b05_lsh_overlap",
    _BITS
    + f""", s AS (SELECT test_case_id, count(*) AS n, string_agg(bit, ',' ORDER BY bit) AS bits FROM b GROUP BY 1), r AS (SELECT bits, min(test_case_id) AS rep, min(n) AS n FROM s GROUP BY bits),
    e AS (SELECT rep, n, bit FROM r JOIN b ON test_case_id = rep), j AS (SELECT x.rep AS a, y.rep AS b, count(*) * 1e0 / (x.n + y.n - count(*)) AS similarity FROM e x JOIN e y USING (bit) WHERE x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n)
    SELECT a, b, {R("similarity")} AS similarity, 'pair' AS kind FROM j WHERE similarity >= 0.3 UNION ALL SELECT test_case_id, rep, 1, 'member' FROM s JOIN r USING (bits) WHERE test_case_id <> rep""",
)
def b05(spark, sf_dir):
    return rounded(sketch.overlaps(sketch.bloom(load(spark, sf_dir, "dense"))))


def _signed(n: int) -> str:
    """The signatures by MD5 in long form, of tests that have lines which aren't shared."""
    return _IDF + f""", g AS (SELECT test_case_id, h AS i, min(CAST(concat('0x', substr(md5(concat(s.file, ':', s.line, ':', h)), 1, 13)) AS BIGINT) / {float(1 << 52)}e0 / idf) AS h
    FROM shared s JOIN i ON i.file = s.file AND i.line = s.line AND NOT i.shared, range({n}) r(h) GROUP BY ALL) """


def _signatures(spark, sf_dir, n: int):
    return sketch.weighted_minhash(load(spark, sf_dir, "shared"), load(spark, sf_dir, "requested"), n, family="md5")


@register("b06_weighted_minhash", _signed(16) + f"SELECT id AS test_case_id, CAST(k AS BIGINT) AS i, {R('coalesce(g.h, 0)')} AS h FROM requested, range(16) q(k) LEFT JOIN g ON g.test_case_id = id AND g.i = k")
def b06(spark, sf_dir):
    rows = _signatures(spark, sf_dir, 16).select("test_case_id", F.posexplode("signature").alias("i", "h"))
    return rounded(rows.select("test_case_id", F.col("i").cast("long").alias("i"), "h"))


@register("b07_hash_families", "SELECT * FROM (VALUES ('crc32', true, true), ('md5', true, true), ('xxhash64', true, true)) t(family, filled, bounded)")
def b07(spark, sf_dir):
    """Of each family whether all signatures of tests with lines have numbers, between 0 and 1."""
    out = None
    for family in sorted(sketch.FAMILIES):
        s = sketch.weighted_minhash(load(spark, sf_dir, "shared"), load(spark, sf_dir, "requested"), 4, family=family)
        told = s.agg(F.min(F.size("signature") == 4).alias("filled"), F.min(F.forall("signature", lambda x: (x >= 0) & (x <= 1))).alias("bounded")).select(F.lit(family).alias("family"), "filled", "bounded")
        out = told if out is None else out.union(told)
    return out


@register("b10_progress", _IDF + "SELECT 'lines' AS step, count(*) AS rows FROM shared s JOIN i ON i.file = s.file AND i.line = s.line AND NOT i.shared UNION ALL SELECT 'signatures', count(DISTINCT test_case_id) FROM shared s JOIN i ON i.file = s.file AND i.line = s.line AND NOT i.shared")
def b10(spark, sf_dir):
    told: list[tuple[str, int]] = []
    sketch.weighted_minhash(load(spark, sf_dir, "shared"), load(spark, sf_dir, "requested"), 4, progress=lambda step, rows: told.append((step, rows)))
    return spark.createDataFrame(told, "step string, rows long")


@register("b08_signature_similarity", _signed(32) + f"SELECT x.test_case_id, {R('avg(CASE WHEN abs(x.h - y.h) < 1e-4 THEN 1e0 ELSE 0e0 END)')} AS similarity FROM g x JOIN g y ON y.test_case_id = x.test_case_id + 1 AND y.i = x.i GROUP BY x.test_case_id")
def b08(spark, sf_dir):
    """Each test's signature against that of the next test id, where both have lines that count."""
    sig = _signatures(spark, sf_dir, 32).where(F.exists("signature", lambda x: x != 0))
    other = sig.select((F.col("test_case_id") - 1).alias("test_case_id"), F.col("signature").alias("other"))
    return rounded(sig.join(other, "test_case_id").select("test_case_id", sketch.signature_similarity(F.col("signature"), F.col("other")).alias("similarity")))

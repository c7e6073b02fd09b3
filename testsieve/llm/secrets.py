"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds, leftmost and non-overlapping each: `assign` (a named password, token or key), `access` (access identifiers) and
`hex` (long hexadecimal runs); see BASE. The method adds kinds that are weak evidence on their own: `secret40` (a run of exactly
40 base64 characters), `endpoint` (a URL or host of a service) and `user` (a user or account name). A part's scope reaches
SCOPE_CHARS code points to either side of it. A secret40 is reported only in the scope of an access identifier, an endpoint or
user only in that of an access identifier or a named secret of the same text.

The interval join of parts and scopes is made by running extremes over a text's parts in order of place: the nearest
complementary part before and the nearest after decide. Parts are never paired off, so many parts cost no more than a sort.

Places come from the text's pieces between matches: the lengths of pieces and matches, summed up, are starts and ends. Texts
without the substrings that an expression needs skip it.

Defined cases: null and empty texts have no spans (the digest of the empty string); repeated rows with equal doc_id and text
give repeated result rows; null doc_id is carried through; other columns are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base expressions, and the least length that counts (of group 2, of the match, of the match). For access
#: and hex the least length is in the expression: their matches are whole runs, so a run that fails hides no other.
ASSIGN, ASSIGN_LEAST = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

SECRET40 = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"https?://[A-Za-z0-9._~:@%/?#&=+-]{4,200}|[a-z0-9][a-z0-9.-]{0,100}\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)"
USER = r"""(?i:user(?:name)?|account|login)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._@-]{3,64}"""

#: In the order in which spans of equal starts are listed.
KINDS = ["assign", "access", "hex", "secret40", "endpoint", "user"]
SCOPE_CHARS = 400

_EMPTY = "array<struct<kind:int,i:int,gap:bigint,size:bigint,ok:boolean>>"


def _runs(text: Column, kind: int, pattern: str, needed: Column, least: int = 0) -> Column:
    """Of each match its number, the length of the piece before it, its own, and whether its second group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    rows = F.zip_with(F.arrays_zip(pieces.alias("p"), found.alias("m")), value, lambda x, v: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(v).alias("n")))
    # the piece after the last match has no match beside it
    rows = F.transform(
        F.filter(rows, lambda x: x["size"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].cast("bigint").alias("gap"), x["size"].cast("bigint").alias("size"), (x["n"] >= least).alias("ok")),
    )
    return F.when(needed, rows).otherwise(F.array().cast(_EMPTY))


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, kind, i, gap, size, ok) of all matches, and a row of kind -1 for each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("uid"), F.lower(text).alias("low"))
    has = lambda *words: F.greatest(*[F.contains("low", F.lit(w)) for w in words]) if len(words) > 1 else F.contains("low", F.lit(words[0]))
    named, access = has("passw", "secret", "token", "apikey", "api_key"), F.contains("text", F.lit("AKIA"))
    rows = rows.withColumn("named", named).withColumn("access", access).withColumn("strong", F.col("named") | F.col("access"))
    rows = rows.withColumn("url", F.col("strong") & has("http", ".com", ".net")).withColumn("login", F.col("strong") & has("user", "account", "login")).drop("low")
    every = F.concat(
        F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("ok"))),
        _runs(F.col("text"), 0, ASSIGN, F.col("named"), ASSIGN_LEAST),
        _runs(F.col("text"), 1, ACCESS, F.col("access")),
        _runs(F.col("text"), 2, HEX, F.rlike("text", F.lit("[0-9a-f]{24}"))),
        _runs(F.col("text"), 3, SECRET40, F.col("access")),
        _runs(F.col("text"), 4, ENDPOINT, F.col("url")),
        _runs(F.col("text"), 5, USER, F.col("login")),
    )
    return rows.select("doc_id", "uid", F.explode(every).alias("m")).select("doc_id", "uid", "m.*")


def _near(complement: Column) -> Column:
    """Whether a part that complement marks has this one in its scope."""
    order = Window.partitionBy("doc_id", "uid").orderBy("start", "kind")
    before = F.max(F.when(complement, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(complement, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(F.col("start") - before <= SCOPE_CHARS, F.lit(False)) | F.coalesce(after - F.col("end") <= SCOPE_CHARS, F.lit(False))


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans array<struct<start, kind, end>>): base kinds and linked parts of every row, in
    the order of start and kind (numbers of KINDS)."""
    # all steps below group by doc_id and uid, or by more: one exchange serves them
    rows = _parts(docs).repartition("doc_id", "uid")
    rows = rows.groupBy("doc_id", "uid", "kind", "i").agg(F.max("gap").alias("gap"), F.max("size").alias("size"), F.max("ok").alias("ok"), F.count(F.lit(1)).alias("times"))
    upto = Window.partitionBy("doc_id", "uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).where("ok")
    rows = rows.withColumn("linked", F.when(F.col("kind") < 3, True).when(F.col("kind") == 3, _near(F.col("kind") == 1)).otherwise(_near(F.col("kind").isin(0, 1)))).where("linked")
    span = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))
    rows = rows.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max(F.when(F.col("kind") < 0, F.col("times"))).alias("times"))
    return rows.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

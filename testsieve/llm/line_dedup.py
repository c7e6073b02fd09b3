"""Corpus-wide line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are the parts of a text between newlines; a line's symbols are its words, the parts between single spaces. A line goes
if an earlier line (by doc_id, then position) is equal, or differs by e word insertions, deletions or substitutions where
e <= EDITS = 1 and 1 - e / words of the longer line >= SIMILARITY = 0.8. That is one rule for all lengths; for lines of fewer than
five words it leaves equality alone. Blank lines always stay.

Method. A line of n words emits a hashed key for each word that it could lose (the words left and right of it, and where) and
for each gap where it could have lost one. Lines that share a key differ in that place only, so all lines of a key are within
one edit of one another, and the earliest of a key stands for the others: no pairs within a group are made. Keys are needed
only where a partner can be: two lines within one edit share the words before or after their middle, so lines whose half
(with the word count) nobody else has emit nothing, and others emit the keys of the other half alone. That loses no pair.
Linked lines are verified by the lengths of their common first and last words before they go.

A key is made of two numbers, the digests of the words before and after its place; all digests of a line come from two scans by
doubling steps, so a line of n words costs n log n, not n times its length.

Memory: minima are pre-aggregated before each shuffle and groups are never gathered, so a line, half or key that a third of
all rows share costs a task one row for it. Rows that repeat doc_id and text give their lines once to the search for partners.
Texts are moved twice, by a hash of doc_id and text; what one step has moved or written is deleted when the next has read it.

Defined cases: null text stays null; empty text stays; rows with equal doc_id and text are one document, and each gets its
result; null doc_id comes after all others; other columns are kept as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

EDITS, SIMILARITY = 1, 0.8
#: The words that the longer of two lines of EDITS edits has at least; the rest of a division is no word.
MIN_WORDS = round(EDITS / (1 - SIMILARITY))


def _ord(doc: str, pos: str) -> Column:
    return F.struct(F.col(doc).isNull().alias("last"), F.col(doc).alias("doc_id"), F.col("uid").alias("uid"), F.col(pos).alias("pos"))


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n.cast("int"))


def _last(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), (-n).cast("int"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, pos, line, h1, h2) of all lines that aren't blank."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "")
    return rows.select("doc_id", "uid", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _halves(lines: DataFrame) -> DataFrame:
    """lines(line, n, ...) with halves: keys that a partner shares, the words before (0, 2) or after (1, 3) the middle, for
    partners of at most as many words (0, 1; the tag is our word count) and of one more (2, 3; the tag is theirs)."""
    n, line = F.col("n"), F.col("line")
    less, more = F.floor((n - 1) / 2), F.floor(n / 2)
    lines = lines.withColumn("head", F.when(n >= MIN_WORDS - 1, _first(line, more))).withColumn("tail", F.when(n >= MIN_WORDS - 1, _last(line, more)))
    # of an odd number of words both halves are the same
    short_head, short_tail = F.when(n % 2 == 1, F.col("head")).otherwise(_first(F.col("head"), less)), F.when(n % 2 == 1, F.col("tail")).otherwise(_last(F.col("tail"), less))
    keys = [
        F.when(n >= MIN_WORDS, F.xxhash64(F.lit(0), n, short_head)),
        F.when(n >= MIN_WORDS, F.xxhash64(F.lit(1), n, short_tail)),
        F.when(n >= MIN_WORDS - 1, F.xxhash64(F.lit(0), n + 1, "head")),
        F.when(n >= MIN_WORDS - 1, F.xxhash64(F.lit(1), n + 1, "tail")),
    ]
    return lines.withColumn("halves", F.array(*keys))


def _prefixes(words: Column) -> Column:
    """Of an array of words the digests of its first 0, 1, ... words: every word is hashed with its place, and these hashes are
    combined by a scan of doubling steps."""
    own = F.transform(words, lambda w, i: F.xxhash64(w, i))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(words))).cast("int"))
    scan = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), x.bitwiseXOR(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))).otherwise(x))
    return F.concat(F.array(F.lit(0).cast("bigint")), F.aggregate(steps, own, scan))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, h1) of the deletion neighbourhood, for the halves that a partner can differ in. A line has a key once."""
    n, words = F.col("n"), F.split("line", " ", -1)
    less, more = F.floor((n - 1) / 2), F.floor(n / 2)
    none = F.array().cast("array<bigint>")
    deletions = F.array_union(F.when(F.col("k0"), F.sequence(less, n - 1)).otherwise(none), F.when(F.col("k1"), F.sequence(F.lit(0).cast("bigint"), n - 1 - less)).otherwise(none))
    gaps = F.array_union(F.when(F.col("k2"), F.sequence(more, n)).otherwise(none), F.when(F.col("k3"), F.sequence(F.lit(0).cast("bigint"), n - more)).otherwise(none))
    told = lines.select("h1", "n", deletions.alias("deletions"), gaps.alias("gaps"), _prefixes(words).alias("before"), _prefixes(F.reverse(words)).alias("after"))

    def key(i: Column, after: Column) -> Column:
        return F.xxhash64(i, after, F.get("before", i.cast("int")), F.get("after", after.cast("int")))

    keys = F.concat(F.transform("deletions", lambda i: key(i, F.col("n") - 1 - i)), F.transform("gaps", lambda i: key(i, F.col("n") - i)))
    return told.select("h1", F.explode(keys).alias("key")).select("key", "h1")


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1, F.lit(0))


def _within_one_edit(a: Column, b: Column) -> Column:
    a, b = F.split(a, " "), F.split(b, " ")
    longer = F.greatest(F.size(a), F.size(b))
    # zip_with fills the shorter array with null, so the first unequal place is always found unless the arrays are equal
    same = F.when(a == b, longer).otherwise(_common(a, b) + F.least(_common(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - _common(a, b)))
    return same >= longer - EDITS


def _near(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within the edit bound.

    distinct: (h1, h2, first, n, halves)."""
    # a line has a key once, so a key that occurs twice is shared; line and kind travel as one number, the line's lowest bits
    # being rebuilt by the join (lines that differ in these alone only keep more than they need)
    halves = distinct.select("h1", F.posexplode("halves").alias("kind", "key")).where("key is not null")
    halves = halves.select("key", F.shiftleft(F.shiftright("h1", 2), 2).bitwiseOR(F.col("kind").cast("bigint")).alias("who"))
    shared = halves.groupBy("key").count().where("count > 1").select("key")
    kinds = halves.join(shared, "key", "left_semi").groupBy(F.shiftright("who", 2).alias("line_no"))
    kinds = kinds.agg(*[F.max(F.col("who").bitwiseAND(F.lit(3)) == k).alias(f"k{k}") for k in range(4)])
    lines = distinct.select("h1", "h2", "first", "n").join(kinds, F.shiftright("h1", 2) == F.col("line_no"))
    wanted = lines.groupBy(F.col("first.uid").alias("uid"), F.struct(F.col("first.doc_id").alias("doc_id")).alias("doc"))
    wanted = cut(wanted.agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "n", "k0", "k1", "k2", "k3", "first")).alias("ls")), "wanted")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.struct("doc_id").alias("doc"), "text").join(wanted, ["uid", "doc"])
    # of repeated rows one, as the join left them: beside one another
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("uid", "doc").orderBy("uid"))).where("copy = 1")
    lines = texts.select(F.split("text", "\n").alias("lines"), F.explode("ls").alias("l")).select(F.element_at("lines", F.col("l.pos") + 1).alias("line"), "l.*")
    lines = cut(lines.select("line", "h1", "h2", "first", F.col("n").cast("bigint").alias("n"), "k0", "k1", "k2", "k3"), "lines")
    drop_cut(wanted)
    variants = cut(_variants(lines), "variants")
    shared = variants.groupBy("key").count().where("count > 1").select("key")
    members = cut(variants.join(shared, "key", "left_semi").join(lines.select("h1", "h2", "first"), "h1"), "members")
    drop_cut(variants)
    heads = members.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("head"))
    pairs = members.join(heads, "key").where("first <> head.first").select("h1", "h2", F.col("head.h1").alias("e1"), F.col("head.h2").alias("e2")).distinct()
    text = lines.select("h1", "h2", "line")
    pairs = pairs.join(text, ["h1", "h2"]).join(text.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier")), ["e1", "e2"])
    near = cut(pairs.where(_within_one_edit(F.col("line"), F.col("earlier"))).select("h1", "h2").distinct(), "near")
    drop_cut(members)
    drop_cut(lines)
    return near


def _dedup(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, text, row, kept, n_lines, n_kept): row holds the other columns, so none can clash with ours; kept is the
    text without the lines that go."""
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row")
    docs = docs.select("doc_id", "text", row)
    n = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    found = _lines(docs)
    told = F.struct(_ord("doc_id", "pos").alias("first"), "n", "halves")
    distinct = _halves(found.withColumn("n", n)).select("h1", "h2", told.alias("told")).groupBy("h1", "h2").agg(F.min("told").alias("told"), F.count(F.lit(1)).alias("times"))
    distinct = cut(distinct.select("h1", "h2", "told.*", "times"), "distinct")
    near = _near(distinct, docs)
    marked = distinct.select("h1", "h2", "first", "times").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    once = marked.where("near and times = 1").select(F.col("first.doc_id").alias("doc_id"), F.col("first.uid").alias("uid"), F.col("first.pos").alias("pos"))
    repeated = marked.where("times > 1").select("h1", "h2", "first", "near")
    again = found.select("h1", "h2", "doc_id", "uid", "pos").join(repeated, ["h1", "h2"])
    again = again.where(F.col("near").isNotNull() | (_ord("doc_id", "pos") != F.col("first"))).select("doc_id", "uid", "pos")
    gone = once.union(again).groupBy(F.col("doc_id").alias("_d"), F.col("uid").alias("_u")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.withColumn("_uid", F.xxhash64("doc_id", "text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_uid") == F.col("_u")), "left")
    rows = rows.withColumn("_lines", F.split("text", "\n"))
    lines = F.col("_lines")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    return rows.select("doc_id", "text", "row", kept.alias("kept"), n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size("gone"), F.lit(0))).alias("n_kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, more...) -> the same rows and columns, text being what stays of it; n_chars, if there, counts anew."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return _dedup(docs).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _without(lines: Column, gone: Column) -> Column:
    """lines without the places in gone, by slices between them: time grows with the text, not with lines times places."""
    edges = F.array_sort(F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))))
    between = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(between)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _dedup(docs).select("doc_id", F.col("kept").alias("text"), "n_lines", "n_kept")


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the lines that stay. Documents stay, even where all their lines go."""
    return dedup_lines(docs)

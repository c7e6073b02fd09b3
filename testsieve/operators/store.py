"""Relational operators of the fact store: lookups, joins, statistics, inverted indexes and change impact.

All take and return DataFrames: tests (id, test_run_id, path, method, exec_time_ms, recent_fail_rate), lines (test_case_id,
file, line), runs (id, git_commit_hash, executed_at, created_at)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import complexity, identifier, is_parameterized, line_key, normalized_name, test_kind
from .settle import scratch

#: How far from a changed line a covered one still counts.
NEAR_LINES = 5


def find_many(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ids(id); a semi join, so the list may be of any length."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def by_run(tests: DataFrame, run_id: int) -> DataFrame:
    return tests.where(F.col("test_run_id") == run_id).orderBy("path", "method")


def search(tests: DataFrame, query: str, run_id: int | None = None) -> DataFrame:
    """Tests whose path or method contains the text, letter for letter."""
    found = tests.where(F.contains("path", F.lit(query)) | F.contains("method", F.lit(query)))
    return found if run_id is None else found.where(F.col("test_run_id") == run_id)


def created_between(runs: DataFrame, start: str, end: str) -> DataFrame:
    return runs.where(F.col("created_at").between(start, end)).orderBy(F.desc("created_at"), "id")


def latest(runs: DataFrame) -> DataFrame:
    """The newest run; ties go to the largest id."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def slowest(tests: DataFrame, n: int = 10) -> DataFrame:
    return tests.where("exec_time_ms is not null").orderBy(F.desc("exec_time_ms"), "id").limit(n)


def most_unstable(tests: DataFrame, n: int = 10) -> DataFrame:
    return tests.where("recent_fail_rate > 0").orderBy(F.desc("recent_fail_rate"), "id").limit(n)


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("test_case_id").agg(F.count(F.lit(1)).alias("lines_covered"))


def run_stats(tests: DataFrame, lines: DataFrame) -> DataFrame:
    """Per run: tests, coverage rows, distinct files. The lines go to few rows before they meet the tests."""
    per_run = tests.groupBy("test_run_id").agg(F.count(F.lit(1)).alias("test_count"))
    covered = lines.groupBy("test_case_id", "file").agg(F.count(F.lit(1)).alias("n"))
    covered = covered.join(tests.select(F.col("id").alias("test_case_id"), "test_run_id"), "test_case_id")
    covered = covered.groupBy("test_run_id").agg(F.sum("n").alias("coverage_lines"), F.count_distinct("file").alias("files"))
    return per_run.join(covered, "test_run_id", "left").select("test_run_id", "test_count", F.coalesce("coverage_lines", F.lit(0)).alias("coverage_lines"), F.coalesce("files", F.lit(0)).alias("files"))


def run_statistics(tests: DataFrame, lines: DataFrame) -> DataFrame:
    """Per run: times, lines and failure rates of its tests; nulls count as 0 in sums, not in means."""
    t = tests.join(line_counts(lines).withColumnRenamed("test_case_id", "id"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.groupBy("test_run_id").agg(
        F.count(F.lit(1)).alias("total_tests"),
        zero(F.sum("exec_time_ms")).alias("total_time"),
        zero(F.avg("exec_time_ms")).alias("avg_time"),
        F.coalesce(F.sum("lines_covered"), F.lit(0)).alias("total_lines"),
        zero(F.avg("lines_covered")).alias("avg_lines"),
        zero(F.avg("recent_fail_rate")).alias("avg_fail_rate"),
    )


def coverage_totals(tests: DataFrame, lines: DataFrame) -> DataFrame:
    """Per run: covered tests, files and coverage rows."""
    met = lines.join(tests.select(F.col("id").alias("test_case_id"), "test_run_id"), "test_case_id")
    return met.groupBy("test_run_id").agg(F.count_distinct("test_case_id").alias("tests"), F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("coverage_rows"))


def covered_in_runs(lines: DataFrame, tests: DataFrame) -> DataFrame:
    """The lines whose test is among tests (EXISTS)."""
    return lines.join(tests.select(F.col("id").alias("test_case_id")), "test_case_id", "left_semi")


def nested_lines(tests: DataFrame, lines: DataFrame) -> DataFrame:
    """Each test with its line keys in order, empty without any. The only gathering is by test."""
    nested = lines.groupBy("test_case_id").agg(F.array_sort(F.collect_list(line_key(F.col("file"), F.col("line")))).alias("coverage"))
    out = tests.join(nested.withColumnRenamed("test_case_id", "id"), "id", "left")
    return out.withColumn("coverage", F.coalesce("coverage", F.array().cast("array<string>")))


def coverage_map(lines: DataFrame) -> DataFrame:
    """The inverted index: of each line the tests that cover it, repeats kept."""
    return lines.groupBy(line_key(F.col("file"), F.col("line")).alias("line_key")).agg(F.array_sort(F.collect_list("test_case_id")).alias("tests"))


def shared_threshold(n: Column) -> Column:
    """How many of n tests must cover a line for it to count as shared."""
    return F.when(n > 100, F.greatest(n * 0.6, F.lit(60.0))).when(n > 50, F.greatest(n * 0.7, F.lit(35.0))).otherwise(F.greatest(n * 0.8, F.lit(2.0)))


def line_idf(lines: DataFrame, requested: DataFrame) -> DataFrame:
    """Document frequency and inverse document frequency of each line among the requested tests(id), and whether it is shared.

    The number of tests is one row, joined to all."""
    total = requested.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = lines.dropDuplicates(["test_case_id", "file", "line"]).groupBy("file", "line").agg(F.count(F.lit(1)).alias("df"))
    out = df.crossJoin(F.broadcast(total))
    return out.select("file", "line", "df", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"), (F.col("df") >= shared_threshold(F.col("n"))).alias("shared"))


def idf_stats(idf: DataFrame) -> DataFrame:
    return idf.agg(F.avg("idf").alias("avg_idf"), F.min("idf").alias("min_idf"), F.max("idf").alias("max_idf"), (F.avg(F.col("shared").cast("double")) * 100).alias("shared_percent"))


def change_impact(lines: DataFrame, changes: DataFrame, near: int = NEAR_LINES) -> DataFrame:
    """Per test min(1, direct/total + 0.3 * near/total) over its lines.

    Lines meet changes by file and bucket of near + 1 lines (a change also goes to both neighbouring buckets), never by file
    alone, so a file with very many changes doesn't multiply its lines."""
    width = near + 1
    spread = changes.distinct().select("file", F.col("line").alias("changed"), F.explode(F.array(*[F.floor(F.col("line") / width) + d for d in (-1, 0, 1)])).alias("bucket"))
    keyed = lines.distinct().withColumn("bucket", F.floor(F.col("line") / width))
    hit = keyed.join(spread, ["file", "bucket"]).where(F.abs(F.col("line") - F.col("changed")) <= near)
    hit = hit.groupBy("test_case_id", "file", "line").agg(F.min(F.abs(F.col("line") - F.col("changed"))).alias("distance"))
    hits = hit.groupBy("test_case_id").agg(F.sum((F.col("distance") == 0).cast("long")).alias("direct"), F.sum((F.col("distance") > 0).cast("long")).alias("nearby"))
    out = line_counts(lines).join(hits, "test_case_id", "left").fillna(0, ["direct", "nearby"])
    score = F.least(F.lit(1.0), F.col("direct") / F.col("lines_covered") + F.col("nearby") / F.col("lines_covered") * 0.3)
    return out.select("test_case_id", "direct", "nearby", F.col("lines_covered").alias("total"), score.alias("impact"))


def uniqueness(lines: DataFrame) -> DataFrame:
    """Per test the share of its lines that no other test covers. Coverers are counted per line before tests meet, by an
    aggregation that a hot line doesn't gather in one task; only lines of one coverer go on."""
    own = lines.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"), F.min("test_case_id").alias("test_case_id")).where("n = 1")
    own = own.groupBy("test_case_id").agg(F.count(F.lit(1)).alias("unique_lines"))
    out = line_counts(lines).join(own, "test_case_id", "left").fillna(0, ["unique_lines"])
    return out.select("test_case_id", "unique_lines", F.col("lines_covered").alias("total_lines"), (F.col("unique_lines") / F.col("lines_covered")).alias("uniqueness"))


def parameterized_groups(tests: DataFrame) -> DataFrame:
    """tests(id, name) -> normalized names that several tests share, with the ids in order."""
    groups = tests.groupBy(normalized_name(F.col("name")).alias("base_name")).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1")


def insert_new(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows that an import adds: each once, and only those that aren't stored."""
    keys = ["test_case_id", "file", "line"]
    return fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


#: Characters of a name by which it looks for the paths that may hold it.
GRAM = 4


def _holding(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names(file, name), paths(path) -> (file, path) where the path holds the name. Names meet the paths that have their first
    GRAM characters (all of a shorter name) somewhere, by equality, and only these are searched."""
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.length("path") + 1), lambda i: F.substring("path", i, n)))))
    met = names.withColumn("gram", F.substring("name", 1, GRAM)).join(paths.select("path", F.explode(grams).alias("gram")), "gram")
    return met.where(F.contains("path", F.col("name"))).select("file", "path").distinct()


def _all_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files that take every path: here the result itself is all pairs."""
    return files.select("file").crossJoin(paths.select("path"))


def associate(files: DataFrame, tests: DataFrame) -> DataFrame:
    """files(file) with the tests(id, path) that are taken to cover them: those whose path has the file's base name, every
    test for files named like tests, tests in Unit or Feature folders for every file; files without any take all tests.

    Distinct paths are compared, not the tests."""
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.php$", "")
    files = files.select("file").distinct().withColumn("name", base)
    paths = tests.select("path").distinct()
    general = F.contains("path", F.lit("Unit")) | F.contains("path", F.lit("Feature"))
    like_tests = F.contains("name", F.lit("Test"))
    met = _holding(files.where(~like_tests), paths.where(~general)).union(_all_paths(files.where(like_tests), paths)).union(_all_paths(files.where(~like_tests), paths.where(general)))
    none = files.join(met.select("file").distinct(), "file", "left_anti")
    met = met.union(_all_paths(none, paths))
    return met.join(tests.select("id", "path"), "path").select("file", F.col("id").alias("test_case_id"))


def associate_by_parts(files: DataFrame, tests: DataFrame) -> DataFrame:
    """As associate(), by the parts of a file's path: paths that have `<base>Test` or any part; files named Test.php without
    any take all tests."""
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.php$", "")
    files = files.select("file").distinct()
    parts = F.filter(F.split("file", "/"), lambda p: p != "")
    paths = tests.select("path").distinct()
    met = _holding(files.select("file", F.explode(F.array_distinct(F.concat(F.array(F.concat(base, F.lit("Test"))), parts))).alias("name")), paths)
    none = files.where(F.contains("file", F.lit("Test.php"))).join(met.select("file").distinct(), "file", "left_anti")
    met = met.union(_all_paths(none, paths))
    return met.join(tests.select("id", "path"), "path").select("file", F.col("id").alias("test_case_id"))


def ordered_details(groups: DataFrame, tests: DataFrame) -> DataFrame:
    """groups(key, ids) with the methods of the ids, in their order, null for those that aren't there."""
    parts = groups.select("key", F.posexplode("ids").alias("pos", "id")).join(tests.select("id", "method"), "id", "left")
    found = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "method"))).alias("d"))
    return found.select("key", F.transform("d", lambda x: x["method"]).alias("methods"))


def metadata(tests: DataFrame, lines: DataFrame, changes: DataFrame) -> DataFrame:
    """The metadata record of every test."""
    t = tests.join(line_counts(lines).withColumnRenamed("test_case_id", "id"), "id", "left")
    t = t.join(change_impact(lines, changes).select(F.col("test_case_id").alias("id"), "impact"), "id", "left")
    t = t.join(uniqueness(lines).select(F.col("test_case_id").alias("id"), "uniqueness"), "id", "left")
    name = identifier(F.col("path"), F.col("method"))
    kind = test_kind(F.col("path"), F.col("method"))
    return t.select(
        "id",
        name.alias("test_identifier"),
        normalized_name(name).alias("normalized"),
        is_parameterized(name).alias("parameterized"),
        kind.alias("kind"),
        F.coalesce("exec_time_ms", F.lit(0.0)).alias("execution_time_ms"),
        F.coalesce("recent_fail_rate", F.lit(0.0)).alias("fail_rate"),
        F.coalesce("lines_covered", F.lit(0)).alias("lines_covered"),
        F.coalesce("impact", F.lit(0.0)).alias("change_impact"),
        F.coalesce("uniqueness", F.lit(0.0)).alias("uniqueness"),
        complexity(F.col("exec_time_ms"), F.col("lines_covered"), kind, 6).alias("complexity"),
    )


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Of each cluster the feedback that came last; a pre-aggregated maximum, no window over a busy cluster."""
    last = feedback.groupBy("cluster_id").agg(F.max_by(F.struct("pos", "action", "reason"), F.col("pos")).alias("f"))
    return last.select("cluster_id", "f.pos", "f.action", "f.reason")


def text_blocks(lines: DataFrame) -> DataFrame:
    """Rows (source, pos, text) of coverage reports -> (source, test, file, line): `TEST: name` opens a block, rows `file:line`
    belong to it, other rows are skipped; of a test's blocks the last that has rows stands."""
    order = Window.partitionBy("source").orderBy("pos")
    rows = lines.withColumn("text", F.trim("text")).where("text <> ''")
    header = F.regexp_extract("text", "^TEST: *(.*)$", 1)
    rows = rows.withColumn("header", F.when(F.startswith("text", F.lit("TEST:")), F.struct("pos", header.alias("name"))))
    rows = rows.withColumn("block", F.last("header", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.instr("text", ":")
    facts = rows.where(F.col("header").isNull() & F.col("block").isNotNull() & (at > 0)).select(
        "source", F.col("block.name").alias("test"), F.col("block.pos").alias("block_pos"), F.substring("text", F.lit(1), at - 1).alias("file"), F.substring("text", at + 1, F.length("text")).try_cast("int").alias("line")
    )
    final = facts.groupBy("source", "test").agg(F.max("block_pos").alias("block_pos"))
    return facts.join(final, ["source", "test", "block_pos"], "left_semi").select("source", "test", "file", "line")


class RunCache:
    """Results of queries by their name and run, kept as tables in the shared folder for some seconds, so that the views of a run
    don't read its facts again. What is older, or cleared, is made anew."""

    def __init__(self, seconds: float = 3600, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock = seconds, clock
        self._held: dict[tuple[str, int], tuple[float, DataFrame, str]] = {}

    def get(self, name: str, run_id: int, make: Callable[[], DataFrame]) -> DataFrame:
        found = self._held.get((name, run_id))
        if found is not None and self.clock() - found[0] < self.seconds:
            return found[1]
        self.clear(run_id, name)
        df = make()
        path = scratch(df.sparkSession, "cached")
        df.write.parquet(path)
        self._held[name, run_id] = (self.clock(), df.sparkSession.read.schema(df.schema).parquet(path), path)
        return self._held[name, run_id][1]

    def clear(self, run_id: int | None = None, name: str | None = None) -> int:
        """Forgets what is kept of a run, of a name, or all; returns how many results."""
        gone = [k for k in self._held if name in (None, k[0]) and run_id in (None, k[1])]
        for k in gone:
            _, df, path = self._held.pop(k)
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        return len(gone)

"""Readers of facts: JSON maps, coverage reports as text and XML, test results. All give DataFrames; none collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import class_from_path, code_tokens, method_body, normalize_code, skipped_file, split_identifier
from ..operators.store import text_blocks

DEFAULT_EXCLUDE, DEFAULT_FOCUS = ["vendor", "bootstrap", "node_modules", "public", "storage"], ["app", "src"]


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, value) of each file under the path; Spark's own error for a path that isn't there."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")


def json_map(spark: SparkSession, path: str, value: str, lines: bool = False) -> DataFrame:
    """(name, value) of JSON objects whose values have one type; an error where a file isn't such an object. With lines, each line
    of a file is an object, so that files of any size are read in parts."""
    parsed = F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})
    checked = F.when(F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{")), parsed).otherwise(F.raise_error(F.lit("not a JSON object")).cast(f"map<string,{value}>"))
    texts = spark.read.text(path).where(F.trim("value") != "") if lines else whole_text(spark, path)
    return texts.select(F.explode(checked).alias("name", "value"))


def test_sources(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return json_map(spark, path, "string", lines).withColumnRenamed("value", "source")


def coverage_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, file, line) of {test: ["file:line", ...]}."""
    rows = json_map(spark, path, "array<string>", lines).select("name", F.explode("value").alias("key"))
    return rows.select("name", F.regexp_extract("key", "^(.*):[^:]*$", 1).alias("file"), F.regexp_extract("key", ":([^:]*)$", 1).try_cast("int").alias("line"))


def vectors_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, v): numbers are read in single precision and widened."""
    return json_map(spark, path, "array<float>", lines).select("name", F.col("value").cast("array<double>").alias("v"))


def clusters_json(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, name) of {"clusters": {id: [names]}}."""
    parsed = F.from_json("value", "struct<clusters:map<string,array<string>>>")
    return whole_text(spark, path).select(F.explode(parsed["clusters"]).alias("cluster_id", "names")).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.explode("names").alias("name"))


def saved_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, name) of what write_clusters() left: a JSON line per cluster, and one of metadata."""
    parsed = F.from_json("value", "struct<cluster_id:bigint,tests:array<string>>")
    return spark.read.text(path).select(parsed.alias("c")).where("c.tests is not null").select("c.cluster_id", F.explode("c.tests").alias("name"))


def serialized_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(test, file, line) of a serialized coverage object. The native form of such objects is a program's memory, which only that
    program can read; it is taken as JSON, {file: {line: [tests]}}, an object a file."""
    lines = json_map(spark, path, "map<string,array<string>>").select(F.col("name").alias("file"), F.explode("value").alias("line", "tests"))
    return inverted_coverage(lines.select("file", F.col("line").cast("long").alias("line"), "tests"))


def coverage_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, test, file, line) of text reports; each file is one ordered block of lines."""
    lines = whole_text(spark, path).select("source", F.posexplode(F.split("value", "\r?\n")).alias("pos", "text"))
    return text_blocks(lines)


def inverted_coverage(rows: DataFrame) -> DataFrame:
    """rows(file, line, tests array) -> (test, file, line); lines without tests are left out."""
    return rows.where("tests is not null").select(F.explode("tests").alias("test"), "file", "line")


def synthetic_tests(rows: DataFrame) -> DataFrame:
    """(test, file, line) where no test is known: one `Test_<base>_<n>` per file that has covered lines, n by file from 0."""
    covered = rows.where("covered > 0").select("file", "line")
    files = covered.select("file").distinct().withColumn("n", F.row_number().over(Window.orderBy("file")) - 1)
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.php$", "")
    return covered.join(files.select("file", F.concat(F.lit("Test_"), base, F.lit("_"), F.col("n")).alias("test")), "file").select("test", "file", "line")


def _attribute(tag: str, name: str) -> Column:
    return F.regexp_extract(tag, name + r'\s*=\s*"([^"]*)"', 1)


def clover_lines(spark: SparkSession, path: str, exclude: list[str] = DEFAULT_EXCLUDE, focus: list[str] = DEFAULT_FOCUS) -> DataFrame:
    """(file, line) of the covered lines of Clover reports. A report is read tag by tag: a file tag holds for the line tags
    that follow it."""
    tags = whole_text(spark, path).select("source", F.posexplode(F.regexp_extract_all("value", F.lit("<(?:file|line)\\s[^>]*>"), F.lit(0))).alias("pos", "tag"))
    order = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tags = tags.withColumn("file", F.last(F.when(F.startswith("tag", F.lit("<file")), _attribute("tag", "name")), True).over(order))
    lines = tags.where(F.startswith("tag", F.lit("<line"))).select("file", _attribute("tag", "num").cast("int").alias("line"), _attribute("tag", "count").cast("int").alias("n"))
    return lines.where((F.col("n") > 0) & F.col("file").isNotNull() & ~skipped_file(F.col("file"), exclude, focus)).select("file", "line").distinct()


def clover_tests(spark: SparkSession, path: str) -> DataFrame:
    """(path, method): methods `test...` of classes named like tests; else `testGeneral` of files named Test.php; else one
    default row. Each fallback is used only if what comes before found nothing."""
    tags = whole_text(spark, path).select("source", F.posexplode(F.regexp_extract_all("value", F.lit("<(?:file|class|method)\\s[^>]*>|<line\\s[^>]*type=\"method\"[^>]*>"), F.lit(0))).alias("pos", "tag")).persist()
    order = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    methods = tags.withColumn("path", F.last(F.when(F.startswith("tag", F.lit("<class")), _attribute("tag", "name")), True).over(order))
    methods = methods.where(F.rlike("tag", F.lit("^<(method|line)")) & F.contains("path", F.lit("Test"))).select("path", _attribute("tag", "name").alias("method")).where(F.startswith("method", F.lit("test"))).distinct()
    if not methods.isEmpty():
        return methods
    files = tags.where(F.startswith("tag", F.lit("<file"))).select(_attribute("tag", "name").alias("f")).where(F.contains("f", F.lit("Test.php")))
    files = files.select(class_from_path(F.col("f")).alias("path"), F.lit("testGeneral").alias("method")).distinct()
    return files if not files.isEmpty() else spark.createDataFrame([("Tests\\Unit\\DefaultTest", "testGeneral")], "path string, method string")


def junit_tests(spark: SparkSession, path: str) -> DataFrame:
    """(path, method, exec_time_ms, recent_fail_rate) of all test cases of JUnit-style results, however deep their suites lie;
    a case with a failure or error inside has rate 1."""
    cases = whole_text(spark, path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<testcase\s[^>]*/>|<testcase\s[^>]*[^/]>.*?</testcase>"), F.lit(0))).alias("case"))
    head = F.regexp_extract("case", r"^<testcase\s[^>]*>", 0)
    cases = cases.select("case", head.alias("head"))
    failed = F.rlike("case", F.lit(r"<(failure|error)[\s/>]"))
    attribute = lambda name: F.regexp_extract("head", r'\s' + name + r'\s*=\s*"([^"]*)"', 1)
    return cases.select(attribute("class").alias("path"), attribute("name").alias("method"), F.floor(F.coalesce(attribute("time").try_cast("double"), F.lit(0.0)) * 1000).cast("double").alias("exec_time_ms"), failed.cast("double").alias("recent_fail_rate"))


def format_of(name: Column, head: Column) -> Column:
    """clover or cov, by a file's name and beginning."""
    report = F.contains(head, F.lit("<coverage")) | F.contains(head, F.lit("clover.xml"))
    xml = F.startswith(F.ltrim(head, F.lit(" \t\r\n")), F.lit("<?xml"))
    return F.when(F.endswith(name, F.lit(".xml")) & report, "clover").when(F.endswith(name, F.lit(".cov")), "cov").when(xml, "clover").otherwise("cov")


def table(spark: SparkSession, path: str, run_id: int | None = None) -> DataFrame:
    """A stored fact table; with a run only its partition is read."""
    df = spark.read.parquet(path)
    return df if run_id is None else df.where(F.col("test_run_id") == run_id)


def identified(rows: DataFrame, column: str = "test") -> DataFrame:
    """rows with path and method of their test identifier."""
    path, method = split_identifier(F.col(column))
    return rows.withColumn("path", path).withColumn("method", method)


FEEDBACK = "cluster_id long, action string, reason string, timestamp string"


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, action, reason, timestamp, pos) of a log of JSON lines; blank and broken lines are left out. pos is a number by
    timestamp and place in the file, so that a later line has a larger one whatever files the log lies in."""
    rows = spark.read.text(path).select(F.from_json("value", FEEDBACK).alias("r"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("place"))
    rows = rows.select("r.*", "place").where("cluster_id is not null and action is not null")
    order = Window.partitionBy("cluster_id").orderBy("timestamp", "place.file", "place.line")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).drop("place")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, v) from JSON, or from YAML files of the form `name: [numbers]`, a line each."""
    if not path.endswith((".yaml", ".yml")):
        return vectors_json(spark, path)
    rows = spark.read.text(path).where(F.trim("value") != "")
    name = F.trim(F.regexp_extract("value", r"""^["']?(.*?)["']?\s*:\s*\[""", 1))
    numbers = F.from_json(F.regexp_extract("value", r":\s*(\[[^\]]*\])\s*$", 1), "array<float>", {"mode": "FAILFAST"})
    return rows.select(name.alias("name"), numbers.cast("array<double>").alias("v"))


def test_code(tests: DataFrame, files: DataFrame) -> DataFrame:
    """tests(id, path, method), files(path, content) -> (id, source): what vectors are made of. A class name stands for itself;
    of a file the normalized method is taken; a path that is neither fails the run, as an unreadable test would."""
    met = tests.join(files.select("path", "content"), "path", "left")
    head = F.concat(F.lit("test_method "), F.col("method"), F.lit(" "))
    missing = F.raise_error(F.concat(F.lit("test file not found: "), F.col("path"))).cast("string")
    body = F.array_join(code_tokens(normalize_code(method_body(F.col("content"), F.col("method")))), " ")
    named = F.concat(F.lit("class "), "path", F.lit(" method "), "method")
    source = F.when(F.contains("path", F.lit("\\")), named).when(F.col("content").isNull(), missing).otherwise(body)
    return met.select("id", F.concat(head, source).alias("source"))


def require_files(spark: SparkSession, *paths: str) -> None:
    """An error that names the paths that aren't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    missing = [p for p, h in zip(paths, found) if not h.getFileSystem(conf).exists(h)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

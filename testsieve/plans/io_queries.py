"""Registered queries of readers, writers, settings and whole runs. Each writes what it needs to a folder of its own, reads it back
through the operator and returns the rows; the SQL takes the same rows from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import cluster, entropy, findings, reduce, safety, store
from ..operators.settle import scratch, settle
from ..sources import readers, sinks
from . import pipeline
from .catalog import register
from .config import PRESETS, Settings
from .fixtures import ctes, load
from .store_queries import R, rounded
from .vector_queries import _E, _FOUND, _R02, _V, HIGH, MEDIUM, _finding_inputs, _parts, _redundant

_PATHS = "SELECT CAST(id AS VARCHAR) AS name, path AS value FROM paths"


def _map(df: DataFrame, name: str, value) -> DataFrame:
    return df.select(F.col(name).cast("string").alias("name"), (F.col(value) if isinstance(value, str) else value).alias("value"))


@register("s01_read_json", ctes("paths") + _PATHS)
def s01(spark, sf_dir):
    path = scratch(spark, "s01")
    sinks.write_json_objects(_map(load(spark, sf_dir, "paths"), "id", "path"), path, 100)
    return readers.json_map(spark, path, "string")


@register("s02_test_sources", ctes("snippets") + "SELECT CAST(id AS VARCHAR) AS name, source FROM snippets")
def s02(spark, sf_dir):
    path = scratch(spark, "s02")
    sinks.write_json_objects(_map(load(spark, sf_dir, "snippets"), "id", "source"), path)
    return readers.test_sources(spark, path)


def _keys():
    return F.transform(F.collect_set(F.struct("file", "line")), lambda x: F.concat(x["file"], F.lit(":"), x["line"]))


@register("s03_coverage_json", ctes("lines") + "SELECT CAST(test_case_id AS VARCHAR) AS name, file, line FROM lines")
def s03(spark, sf_dir):
    path = scratch(spark, "s03")
    sinks.write_json_objects(_map(load(spark, sf_dir, "lines").groupBy("test_case_id").agg(_keys().alias("value")), "test_case_id", "value"), path, 500)
    return readers.coverage_json(spark, path).withColumn("line", F.col("line").cast("long"))


_SUMS = _V + f"SELECT CAST(id AS VARCHAR) AS name, CAST(len(v) AS BIGINT) AS columns, {R('list_sum(v)')} AS total, {R('v[64]')} AS last_value FROM vectors"


def _sums(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("name", F.size("v").cast("long").alias("columns"), X.total(F.col("v")).alias("total"), F.element_at("v", -1).alias("last_value")))


@register("s04_vectors_json", _SUMS)
def s04(spark, sf_dir):
    path = scratch(spark, "s04")
    sinks.write_json_objects(_map(load(spark, sf_dir, "vectors"), "id", "v"), path, 200)
    return _sums(readers.vectors_json(spark, path))


@register("s05_vectors_yaml", _SUMS)
def s05(spark, sf_dir):
    path = scratch(spark, "s05") + ".yaml"
    rows = load(spark, sf_dir, "vectors").select(F.format_string("'%s': %s", F.col("id").cast("string"), F.to_json("v")).alias("value"))
    rows.write.text(path)
    return _sums(readers.vectors(spark, path))


@register("s07_serialized_coverage", ctes("dense") + "SELECT CAST(test_case_id AS VARCHAR) AS test, file, line FROM dense")
def s07(spark, sf_dir):
    path = scratch(spark, "s07")
    tests = load(spark, sf_dir, "dense").groupBy("file", "line").agg(F.collect_set(F.col("test_case_id").cast("string")).alias("tests"))
    maps = tests.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("string"), "tests"))).alias("value"))
    sinks.write_json_objects(_map(maps, "file", "value"), path, 2)
    return readers.serialized_coverage(spark, path)


def _one_file_a_row(rows: DataFrame, path: str) -> None:
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


_XML_FILES = "SELECT p_partkey, p_brand, CASE p_size % 4 WHEN 0 THEN concat('/srv/app/', p_brand, '.php') WHEN 1 THEN concat('/srv/vendor/app/', p_brand, '.php') WHEN 2 THEN concat('/srv/src/', p_type, '.php') ELSE concat('/srv/lib/', p_type, '.php') END AS file, p_size AS line, p_partkey % 3 AS n FROM part"


@register("s11_clover_lines", f"WITH f AS ({_XML_FILES}) SELECT DISTINCT file, CAST(line AS INT) AS line FROM f WHERE n > 0 AND (contains(file, '/app/') OR contains(file, '/src/')) AND NOT contains(file, '/vendor/')")
def s11(spark, sf_dir):
    path = scratch(spark, "s11")
    p, size = load(spark, sf_dir, "part"), F.col("p_size") % 4
    name = F.when(size == 0, F.concat(F.lit("/srv/app/"), "p_brand", F.lit(".php"))).when(size == 1, F.concat(F.lit("/srv/vendor/app/"), "p_brand", F.lit(".php")))
    name = name.when(size == 2, F.concat(F.lit("/srv/src/"), "p_type", F.lit(".php"))).otherwise(F.concat(F.lit("/srv/lib/"), "p_type", F.lit(".php")))
    tag = F.format_string('<line num="%s" type="stmt" count="%s"/>', F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"))
    files = p.select("p_brand", name.alias("name"), tag.alias("tag")).groupBy("p_brand", "name").agg(F.array_join(F.collect_list("tag"), "").alias("tags"))
    text = F.concat(F.lit('<?xml version="1.0"?><coverage><project>'), F.array_join(F.collect_list(F.concat(F.lit('<file name="'), "name", F.lit('">'), "tags", F.lit("</file>"))), ""), F.lit("</project></coverage>"))
    _one_file_a_row(files.groupBy("p_brand").agg(text.alias("value")).select("value"), path)
    return readers.clover_lines(spark, path)


@register("s12_test_methods", "SELECT DISTINCT concat(p_type, 'Test') AS path, concat('test_', p_size) AS method FROM part WHERE p_size % 2 = 0")
def s12(spark, sf_dir):
    path = scratch(spark, "s12")
    p = load(spark, sf_dir, "part")
    method = F.concat(F.lit('<method name="'), F.when(F.col("p_size") % 2 == 0, "test_").otherwise("helper_"), "p_size", F.lit('"/>'))
    classes = p.groupBy("p_type").agg(F.array_join(F.collect_set(method), "").alias("m")).select(F.concat(F.lit('<class name="'), "p_type", F.lit('Test">'), "m", F.lit('</class><class name="Plain"><method name="test_no"/></class>')).alias("value"))
    _one_file_a_row(classes, path)
    return readers.clover_tests(spark, path)


@register("s14_format", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cov' WHEN page_id % 3 = 1 THEN 'clover' WHEN page_id % 2 = 0 THEN 'clover' ELSE 'cov' END AS format FROM pages")
def s14(spark, sf_dir):
    """Names end in .cov, .xml or .txt by thirds; heads are those of reports, of other XML, or of pages."""
    i = F.col("page_id")
    name = F.concat("url", F.when(i % 3 == 0, ".cov").when(i % 3 == 1, ".xml").otherwise(".txt"))
    head = F.when(i % 3 == 1, F.concat(F.lit("\n<coverage>"), "html")).when(i % 2 == 0, F.concat(F.lit(" <?xml?>"), "html")).otherwise(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", readers.format_of(name, head).alias("format"))


_STORED = ("id", "test_run_id", "path", "method")


@register("s15_stored_tests", ctes("tests") + "SELECT id, path, method FROM tests WHERE test_run_id = 3")
def s15(spark, sf_dir):
    path = scratch(spark, "s15")
    sinks.append_facts(load(spark, sf_dir, "tests").select(*_STORED), path)
    return readers.table(spark, path, 3).select("id", "path", "method")


@register("k01_json_lines", ctes("paths") + _PATHS)
def k01(spark, sf_dir):
    path = scratch(spark, "k01")
    sinks.write_json_map(_map(load(spark, sf_dir, "paths"), "id", "path"), path)
    return readers.json_map(spark, path, "string", lines=True)


@register("k02_saved_vectors", _SUMS)
def k02(spark, sf_dir):
    path = scratch(spark, "k02")
    sinks.write_json_map(_map(load(spark, sf_dir, "vectors"), "id", "v"), path)
    return _sums(readers.vectors_json(spark, path, lines=True))


@register("k03_saved_clusters", _V + "SELECT cluster_id, CAST(id AS VARCHAR) AS name FROM vectors")
def k03(spark, sf_dir):
    path = scratch(spark, "k03")
    sinks.write_clusters(load(spark, sf_dir, "vectors").select("cluster_id", F.col("id").cast("string").alias("name")), {"algorithm": "given"}, path)
    return readers.saved_clusters(spark, path)


@register("k07_saved_results", _R02 + "SELECT id AS test, cluster_id, status, similar_count, replace(similar_tests, ',', '; ') AS similar_tests FROM r")
def k07(spark, sf_dir):
    """The redundancy report of all that a run saves; its clusters are read back as well, and only their tests are returned."""
    folder, v = scratch(spark, "k07"), load(spark, sf_dir, "vectors")
    named = v.select("cluster_id", "id", F.col("id").cast("string").alias("name"))
    result = pipeline.Result(named.select("cluster_id", "name"), _redundant(spark, sf_dir), None, None, None)
    sinks.save_results(result, named.agg(F.count(F.lit(1)).alias("tests")), {"algorithm": "given"}, folder, _map(v, "id", "v"))
    report = spark.read.csv(f"{folder}/redundancy_report.csv", header=True, schema="test long, cluster_id long, status string, similar_count long, max_similarity string, similar_tests string")
    kept = readers.saved_clusters(spark, f"{folder}/clusters.json").select(F.col("name").cast("long").alias("test"), "cluster_id")
    return report.drop("max_similarity").fillna("", ["similar_tests"]).join(kept, ["test", "cluster_id"], "left_semi")


def _saved(spark, sf_dir, fmt: str) -> str:
    path = f"{scratch(spark, 'report')}.{fmt}"
    m, p, lines = _finding_inputs(spark, sf_dir)
    found = settle(findings.findings(m, p, lines, HIGH, MEDIUM), "found")
    sinks.save_findings(found, findings.report_counts(found), fmt, path)
    return path


@register("k08_saved_findings", _FOUND + f"SELECT cluster_id, representative, redundant_tests, {R('score')} AS score, priority FROM fd")
def k08(spark, sf_dir):
    rows = spark.read.schema("cluster_id long, representative long, redundant_tests array<long>, score double, priority string").json(_saved(spark, sf_dir, "json"), multiLine=True)
    return rounded(rows.select("cluster_id", "representative", F.array_join(F.array_sort("redundant_tests").cast("array<string>"), ",").alias("redundant_tests"), "score", "priority"))


def _lines_of(spark, path: str, pattern: str) -> DataFrame:
    return spark.read.text(path).where(F.rlike("value", F.lit(pattern))).select(F.regexp_extract("value", pattern, 1).alias("found"))


@register("k09_yaml_findings", _FOUND + "SELECT 'cluster ' || cluster_id AS found FROM fd UNION ALL SELECT 'priority ' || priority FROM fd")
def k09(spark, sf_dir):
    path = _saved(spark, sf_dir, "yaml")
    ids = _lines_of(spark, path, r"^[- ] +cluster_id: (-?\d+)$").select(F.concat(F.lit("cluster "), "found").alias("found"))
    return ids.union(_lines_of(spark, path, r'^[- ] +priority: "(\w+)"$').select(F.concat(F.lit("priority "), "found").alias("found")))


@register("k11_html_findings", _FOUND + "SELECT cluster_id, representative, priority FROM fd")
def k11(spark, sf_dir):
    text = spark.read.text(_saved(spark, sf_dir, "html")).where(F.startswith("value", F.lit("<section")))
    get = lambda p: F.regexp_extract("value", p, 1)
    return text.select(get(r"<h2>Cluster (-?\d+)<").cast("long").alias("cluster_id"), get(r"Representative: (\d+)<").cast("long").alias("representative"), get(r"class='(\w+)'").alias("priority"))


@register("k12_batched_facts", ctes("tests") + "SELECT test_run_id, count(*) AS tests, CAST(sum(id) AS BIGINT) AS ids FROM tests GROUP BY 1")
def k12(spark, sf_dir):
    path, tests = scratch(spark, "k12"), load(spark, sf_dir, "tests").select(*_STORED)
    for part in range(3):
        sinks.append_facts(tests.where(F.col("id") % 3 == part), path)
    return readers.table(spark, path).groupBy(F.col("test_run_id").cast("long").alias("test_run_id")).agg(F.count(F.lit(1)).alias("tests"), F.sum("id").alias("ids"))


@register("k13_updated_run", ctes("runs") + "SELECT id, CASE WHEN id = 3 THEN 'abc' ELSE git_commit_hash END AS git_commit_hash FROM runs")
def k13(spark, sf_dir):
    path = scratch(spark, "k13")
    load(spark, sf_dir, "runs").write.parquet(path)
    sinks.update_run(spark, path, 3, git_commit_hash="abc")
    return spark.read.parquet(path).select("id", "git_commit_hash")


@register("f22_created_run", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'abc', true), (CAST(8 AS BIGINT), 'def', true)) t(id, git_commit_hash, stamped)")
def f22(spark, sf_dir):
    path = scratch(spark, "f22")
    sinks.create_run(spark, path, 7, "abc")
    sinks.create_run(spark, path, 8, "def")
    return spark.read.parquet(path).select("id", "git_commit_hash", (F.col("executed_at").isNotNull() & (F.col("created_at") <= F.current_timestamp())).alias("stamped"))


@register(
    "k15_feedback",
    "WITH l AS (SELECT user_id AS cluster_id, CASE event_type WHEN 'error' THEN 'ignore' WHEN 'view' THEN 'keep' ELSE 'merge' END AS action, props AS reason FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) "
    "SELECT cluster_id, CASE WHEN cluster_id = 1 THEN 'keep' ELSE action END AS action, CASE WHEN cluster_id = 1 THEN 'late' ELSE reason END AS reason FROM l WHERE cluster_id <> 2",
)
def k15(spark, sf_dir):
    """Appended, exported, imported elsewhere, cleared for one cluster and compacted; then the latest of each cluster."""
    log, exported, other = (scratch(spark, n) for n in ("log", "exported", "other"))
    e = load(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "ignore").when(F.col("event_type") == "view", "keep").otherwise("merge")
    e.select(F.col("user_id").alias("cluster_id"), action.alias("action"), F.col("props").alias("reason"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp")).write.json(log)
    sinks.append_feedback(spark, log, 1, "keep", "late", "9")
    sinks.export_feedback(spark, log, exported)
    sinks.import_feedback(spark, other, exported)
    sinks.clear_feedback(spark, other, 2)
    sinks.compact_feedback(spark, other)
    return sinks.read_feedback(spark, other).select("cluster_id", "action", "reason")


@register("v07_test_code", ctes("tests") + "SELECT id, concat('test_method ', method, ' class App', chr(92), path, ' method ', method) AS source FROM tests")
def v07(spark, sf_dir):
    t = load(spark, sf_dir, "tests").select("id", F.concat(F.lit("App\\"), "path").alias("path"), "method")
    return readers.test_code(t, spark.createDataFrame([], "path string, content string"))


@register("f09_parameterized", ctes("data_sets") + "SELECT id, id % 4 <> 3 AS parameterized FROM data_sets")
def f09(spark, sf_dir):
    from ..functions.metadata import is_parameterized

    return load(spark, sf_dir, "data_sets").select("id", is_parameterized(F.col("name")).alias("parameterized"))


@register("f23_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat(chr(123), '\"k\":', json_extract_string(props, '$.k'), chr(125)) AS again FROM events")
def f23(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


@register("p12_settings_checks", "SELECT CAST(n_nationkey AS BIGINT) AS i, n_nationkey BETWEEN 2 AND 22 AND n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1 AS valid FROM nation")
def p12(spark, sf_dir):
    """25 sets of settings: thresholds from -0.1 to 1.1, every third algorithm and every fourth format unknown."""

    def valid(i: int) -> bool:
        try:
            Settings(threshold=(i - 2) / 20, algorithm="other" if i % 3 == 0 else ("kmeans", "hac", "dbscan")[i % 2], output_format="pdf" if i % 4 == 1 else "html")
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(i, valid(i)) for i in range(25)], "i long, valid boolean")


@register("p13_requirements", "SELECT * FROM (VALUES ('documents', 'ok'), ('embeddings', 'missing columns: doc_id, text'), ('nothing', 'missing: nothing')) t(name, told)")
def p13(spark, sf_dir):
    def told(name: str) -> str:
        try:
            readers.require_files(spark, f"{sf_dir}/{name}.parquet")
            readers.require_columns(spark.read.parquet(f"{sf_dir}/{name}.parquet"), ["text", "doc_id"])
        except (FileNotFoundError, ValueError) as e:
            return str(e).replace(f"{sf_dir}/", "").replace(".parquet", "")
        return "ok"

    return spark.createDataFrame([(n, told(n)) for n in ("documents", "embeddings", "nothing")], "name string, told string")


def _axes(spark, sf_dir) -> DataFrame:
    """Two opposite points on each of 25 axes, nearer on later ones: components are the axes, and the mean is 0."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    both = n.select("k", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    x = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda j: F.when(j == F.col("k"), F.col("side") * F.pow(F.lit(0.8), F.col("k"))).otherwise(0.0))
    return both.select((F.col("k") * 2 + (F.col("side") + 1) / 2).cast("long").alias("id"), x.alias("v"))


_AXES = "WITH a AS (SELECT CAST(n_nationkey AS BIGINT) AS k, pow(0.8e0, n_nationkey) AS s FROM nation), "


@register("w09_components", _AXES + f"c AS (SELECT k, {R('s * s / sum(s * s) OVER ()')} AS share, sum(s * s) OVER (ORDER BY k) / sum(s * s) OVER () >= 0.95 AS enough FROM a) SELECT k, share, CAST((SELECT min(k) + 1 FROM c WHERE enough) AS BIGINT) AS needed FROM c")
def w09(spark, sf_dir):
    ratios = reduce.PCA(25, standardized=False).fit(_axes(spark, sf_dir)).explained()
    needed = reduce.components_for(ratios)
    return rounded(spark.createDataFrame([(k, float(r), needed) for k, r in enumerate(ratios)], "k long, share double, needed long"))


@register("d01_axes", _AXES + f"p AS (SELECT 2 * k + (d + 1) // 2 AS id, k, d * s AS x FROM a, (VALUES (-1), (1)) t(d)) SELECT CAST(id AS BIGINT) AS id, k, {R('x')} AS x FROM p WHERE k < 10")
def d01(spark, sf_dir):
    rows = _axes(spark, sf_dir)
    out = reduce.PCA(10, standardized=False).fit(rows).transform(rows)
    return rounded(out.select("id", F.posexplode("v").alias("k", "x")).where("abs(x) > 1e-9").select("id", F.col("k").cast("long").alias("k"), "x"))


@register("d08_reducers", "SELECT * FROM (VALUES ('pca', true), ('random', true), ('tsne', true), ('umap', false), ('own', true)) t(name, known)")
def d08(spark, sf_dir):
    reduce.register_reducer("own", lambda rows, dim, **kw: rows)

    def known(name: str) -> bool:
        try:
            return callable(reduce.get_reducer(name))
        except ValueError:
            return False

    return spark.createDataFrame([(n, known(n)) for n in ("pca", "random", "tsne", "umap", "own")], "name string, known boolean")


@register("e03_weights", _E + f"SELECT id, {R('sq')} AS ws, {R('cq')} AS wc FROM qq")
def e03(spark, sf_dir):
    return rounded(entropy.weights(entropy.quality(_parts(spark, sf_dir))))


# 25 tests in five groups of equal source and coverage, which every algorithm must find.
_GROUPS = "SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation"


def _suite(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"), F.lower(F.regexp_replace("r_name", " ", "")).alias("word"))
    source = F.concat(F.lit("function check"), "word", F.lit("Case() { $this->load"), "word", F.lit("Items(); $this->assert"), "word", F.lit("Total('"), "word", F.lit("'); }"))
    lines = n.select(F.col("id").alias("test_case_id"), F.concat(F.lit("src/"), "word", F.lit(".php")).alias("file"), F.explode(F.sequence(F.lit(1).cast("long"), 5 + F.col("region"))).alias("line"))
    tests = n.select("id", F.concat(F.lit("Suite"), "region").alias("path"), F.concat(F.lit("check_case_"), "id").alias("method"), F.lit(100.0).alias("exec_time_ms"))
    return n.select("id", source.alias("source")), lines, tests


def _first_of_cluster(clusters: DataFrame) -> DataFrame:
    first = clusters.groupBy("cluster_id").agg(F.min("id").alias("first"))
    return clusters.join(first, "cluster_id").select("id", "first")


def _run(spark, sf_dir, **settings) -> pipeline.Result:
    made = Settings(max_features=60, validate_safety=False).with_overrides(settings)
    return pipeline.create(made.algorithm)(spark, *_suite(spark, sf_dir), made)


for _name, _settings in {
    "g01_kmeans_run": {"algorithm": "k-means", "n_clusters": 5}, "g03_dbscan_run": {"algorithm": "dbscan", "eps": 0.1, "min_samples": 3}, "g10_linkage_run": {"algorithm": "agglomerative", "n_clusters": 5},
    "g05_damped_run": {"algorithm": "hac", "n_clusters": 5, "entropy_damping": True},
}.items():

    @register(_name, f"SELECT CAST(id AS BIGINT) AS id, CAST(first AS BIGINT) AS first FROM ({_GROUPS})")
    def _whole_run(spark, sf_dir, settings=_settings):
        return _first_of_cluster(_run(spark, sf_dir, **settings).clusters)


@register("r03_run_findings", f"SELECT CAST(first AS BIGINT) AS representative, string_agg(id, ',' ORDER BY id) FILTER (id <> first) AS redundant_tests, 'high' AS priority FROM ({_GROUPS}) GROUP BY first")
def r03(spark, sf_dir):
    found = _run(spark, sf_dir, algorithm="hac", n_clusters=5).findings
    return found.select("representative", F.array_join(F.array_sort("redundant_tests").cast("array<string>"), ",").alias("redundant_tests"), "priority")


@register("g15_run_summary", "SELECT CAST(5 AS BIGINT) AS n_clusters, CAST(5 AS BIGINT) AS max_size, CAST(5 AS BIGINT) AS findings, CAST(count(*) - 5 AS BIGINT) AS redundant_tests FROM nation")
def g15(spark, sf_dir):
    return pipeline.describe(_run(spark, sf_dir, algorithm="hac", n_clusters=5)).select("n_clusters", "max_size", "findings", "redundant_tests")


@register("g04_pipelines", "SELECT * FROM (VALUES ('k-means', 'kmeans'), ('agglomerative', 'hierarchical'), ('hac', 'hierarchical'), ('dbscan', 'dbscan'), ('spectral', 'unknown'), ('own', 'own')) t(name, resolved)")
def g04(spark, sf_dir):
    pipeline.register("own", pipeline.run)

    def resolved(name: str) -> str:
        try:
            pipeline.create(name)
        except ValueError:
            return "unknown"
        return cluster.ALIASES.get(name, name)

    return spark.createDataFrame([(n, resolved(n)) for n in ("k-means", "agglomerative", "hac", "dbscan", "spectral", "own")], "name string, resolved string")


@register("c14_clusterer_parameters", "SELECT * FROM (VALUES ('dbscan', 'eps', '0.4'), ('dbscan', 'min_samples', '7'), ('hierarchical', 'distance', 'null'), ('hierarchical', 'k', 'null'), ('hierarchical', 'k_max', '10'), ('hierarchical', 'linkage', '\"single\"'), "
          "('kmeans', 'k', '4'), ('kmeans', 'k_max', '10'), ('kmeans', 'k_min', '2'), ('kmeans', 'rounds', '300'), ('kmeans', 'seed', '42'), ('kmeans', 'tries', '10')) t(algorithm, parameter, value)")  # fmt: skip
def c14(spark, sf_dir):
    given = {"dbscan": {"eps": 0.4, "min_samples": 7}, "hac": {"linkage": "single"}, "k-means": {"k": 4}}
    rows = [(cluster.ALIASES.get(n, n), k, json.dumps(v)) for n, more in given.items() for k, v in cluster.get_params(n, **more).items()]
    return spark.createDataFrame(rows, "algorithm string, parameter string, value string")


@register("c14_serialized", _V + "SELECT 'clusters' AS part, concat(cluster_id, ':', string_agg(id, ',' ORDER BY id)) AS told FROM vectors GROUP BY cluster_id UNION ALL SELECT 'parameters', '{\"eps\": 0.4, \"min_samples\": 7}'")
def c14s(spark, sf_dir):
    """A clustering as JSON lines, written, read back."""
    path = scratch(spark, "c14")
    cluster.to_json(load(spark, sf_dir, "vectors").select("id", "cluster_id"), cluster.get_params("dbscan", eps=0.4, min_samples=7)).write.text(path)
    parsed = spark.read.text(path).select("value", F.from_json("value", "struct<cluster_id:bigint,members:array<bigint>,parameters:string>").alias("j"))
    told = F.when(F.col("j.members").isNotNull(), F.concat(F.col("j.cluster_id"), F.lit(":"), F.array_join(F.col("j.members").cast("array<string>"), ","))).otherwise(F.col("j.parameters"))
    return parsed.select(F.when(F.col("j.members").isNotNull(), "clusters").otherwise("parameters").alias("part"), told.alias("told"))


@register("g06_presets", "SELECT * FROM (VALUES ('default', 0.85e0, 0.95e0, 0.85e0), ('lenient', 0.75e0, 0.9e0, 0.75e0), ('strict', 0.9e0, 0.97e0, 0.95e0)) t(name, threshold, high_threshold, very_high)")
def g06(spark, sf_dir):
    rows = [(n, s.threshold, s.high_threshold, s.levels["very_high_redundancy"]) for n, s in PRESETS.items()]
    return spark.createDataFrame(rows, "name string, threshold double, high_threshold double, very_high double").select("name", *[F.col(c).cast("decimal(3,2)").cast("double").alias(c) for c in ("threshold", "high_threshold", "very_high")])


@register("g14_settings", "SELECT * FROM (VALUES ('algorithm', '\"dbscan\"'), ('max_clusters', '9'), ('min_samples', '5'), ('threshold', '0.5'), ('unheard_of', 'null')) t(name, value)")
def g14(spark, sf_dir):
    made = Settings().with_overrides({"algorithm": "dbscan", "max_clusters": 9, "threshold": 0.5, "unheard_of": 1}).as_dict()
    return spark.createDataFrame([(k, json.dumps(made.get(k))) for k in ("algorithm", "max_clusters", "min_samples", "threshold", "unheard_of")], "name string, value string")


def _command(spark, sf_dir, *args: str) -> str:
    """Runs a command on the suite's files; returns the path of its output."""
    from ..__main__ import main

    folder = scratch(spark, "command")
    sources, lines, tests = _suite(spark, sf_dir)
    named = tests.select("id", F.concat_ws("::", "path", "method").alias("name"))
    sinks.write_json_objects(sources.join(named, "id").select("name", F.col("source").alias("value")), f"{folder}/sources")
    keys = lines.join(named, F.col("id") == F.col("test_case_id")).groupBy("name").agg(_keys().alias("value"))
    sinks.write_json_objects(keys, f"{folder}/coverage")
    config = f"{folder}/settings.json"
    spark.createDataFrame([(json.dumps({"max_features": 60, "n_clusters": 5, "validate_safety": False}),)], "value string").coalesce(1).write.text(config)
    main([args[0], f"{folder}/sources", f"{folder}/coverage", f"{folder}/out", "--config", config, *args[1:]])
    return f"{folder}/out"


_NAMED = "SELECT n_regionkey, concat('Suite', n_regionkey, '::check_case_', n_nationkey) AS name FROM nation"


@register("g08_cluster_command", f"WITH n AS ({_NAMED}) SELECT name, min(name) OVER (PARTITION BY n_regionkey) AS first FROM n")
def g08(spark, sf_dir):
    c = readers.saved_clusters(spark, _command(spark, sf_dir, "cluster", "--algorithm", "hac"))
    return c.join(c.groupBy("cluster_id").agg(F.min("name").alias("first")), "cluster_id").select("name", "first")


@register("g09_reduce_command", "SELECT CAST(count(*) / 5 AS BIGINT) - 1 AS redundant, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS findings FROM nation")
def g09(spark, sf_dir):
    out = spark.read.schema("cluster_id long, redundant_tests array<long>").json(_command(spark, sf_dir, "reduce", "--algorithm", "hac"), multiLine=True)
    return out.agg(F.max(F.size("redundant_tests")).cast("long").alias("redundant"), F.count(F.lit(1)).alias("findings"))


@register("v08_vectorize_command", "SELECT concat('Suite', n_regionkey, '::check_case_', n_nationkey) AS name, CAST(640 AS BIGINT) AS columns, CAST(5 + n_regionkey AS BIGINT) > 0 AS filled FROM nation")
def v08(spark, sf_dir):
    v = readers.vectors_json(spark, _command(spark, sf_dir, "vectorize"), lines=True)
    return v.select("name", F.size("v").cast("long").alias("columns"), F.exists("v", lambda x: x != 0).alias("filled"))


@register("g12_run_cache", ctes("tests") + "SELECT test_run_id AS run, count(*) AS first, count(*) AS second, count(*) + 1 AS after_clear FROM tests WHERE test_run_id < 3 GROUP BY 1")
def g12(spark, sf_dir):
    """Counts of three runs, asked for twice, with a test added to each in between, and once more after the memory was cleared."""
    folder, tests = scratch(spark, "g12"), load(spark, sf_dir, "tests").where("test_run_id < 3").select(*_STORED)
    sinks.append_facts(tests, folder)
    cache, out = store.RunCache(3600), []
    ask = lambda run: cache.get("counts", run, lambda: readers.table(spark, folder, run).agg(F.count(F.lit(1)).alias("n")))
    first = {run: ask(run).first()["n"] for run in range(3)}
    sinks.append_facts(tests.groupBy("test_run_id").agg(F.lit(-1).cast("long").alias("id"), F.lit("p").alias("path"), F.lit("m").alias("method")).select(*_STORED), folder)
    second = {run: ask(run).first()["n"] for run in range(3)}
    cache.clear()
    out = [(run, first[run], second[run], ask(run).first()["n"]) for run in range(3)]
    cache.clear()
    return spark.createDataFrame(out, "run long, first long, second long, after_clear long")


@register("g16_environment", "SELECT * FROM (VALUES ('checkpoint folder', true), ('numpy', true), ('pandas', true), ('pyarrow', true), ('pyspark', true), ('workers', true)) t(part, ok)")
def g16(spark, sf_dir):
    return pipeline.environment(spark).select("part", "ok")


@register("q06_split_clusters", "SELECT CAST(0 AS BIGINT) AS against_first, CAST(0 AS BIGINT) AS added")
def q06(spark, sf_dir):
    """Of the parts that clusters were split into: pairs that oppose a part's first name, and names that weren't there; none."""
    n = load(spark, sf_dir, "names").select("cluster_id", "name").distinct()
    split, most = settle(safety.split_unsafe(n), "split"), n.agg(F.max("cluster_id").alias("most"))
    fresh = split.join(F.broadcast(most), F.col("cluster_id") > F.col("most"))
    seeds = fresh.groupBy("cluster_id").agg(F.min("name").alias("seed"))
    against = safety.opposing(fresh.select("cluster_id", "name")).join(seeds, "cluster_id").where("a = seed or b = seed")
    added = split.select("name").join(n, "name", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    return against.agg(F.count(F.lit(1)).alias("against_first")).crossJoin(added)

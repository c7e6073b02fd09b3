from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from testsieve.operators import findings, store
from testsieve.plans import pipeline
from testsieve.plans.config import PRESETS, Settings
from testsieve.sources import readers, sinks
from testsieve.streaming import ingest


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_json_maps(spark, tmp_path):
    got = readers.test_sources(spark, put(tmp_path, "s.json", json.dumps({"a": "x", "b": "y"})))
    assert sorted((r["name"], r["source"]) for r in got.collect()) == [("a", "x"), ("b", "y")]
    cov = readers.coverage_json(spark, put(tmp_path, "c.json", json.dumps({"a": ["C:/x.php:3", "y.php:4"]})))
    assert sorted((r["file"], r["line"]) for r in cov.collect()) == [("C:/x.php", 3), ("y.php", 4)]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.test_sources(spark, put(tmp_path, "bad.json", "[1]")).collect()
    with pytest.raises(Exception):
        readers.coverage_json(spark, put(tmp_path, "bad2.json", json.dumps({"a": 1}))).collect()


def test_coverage_text(spark, tmp_path):
    got = readers.coverage_text(spark, put(tmp_path, "c.txt", "TEST: t\na.php:1\n\nTEST: empty\nTEST: u\nb.php:2"))
    assert sorted((r["test"], r["file"], r["line"]) for r in got.collect()) == [("t", "a.php", 1), ("u", "b.php", 2)]


CLOVER = """<?xml version="1.0"?><coverage><project><file name="/x/app/A.php"><class name="A"/><line num="1" type="stmt" count="2"/><line num="2" type="stmt" count="0"/></file>
<file name="/x/vendor/app/B.php"><line num="1" type="stmt" count="1"/></file><file name="/x/app/UserTest.php"><class name="UserTest"><method name="testOne"/><method name="helper"/></class></file></project></coverage>"""


def test_clover(spark, tmp_path):
    path = put(tmp_path, "clover.xml", CLOVER)
    assert [(r["file"], r["line"]) for r in readers.clover_lines(spark, path).collect()] == [("/x/app/A.php", 1)]
    assert [(r["path"], r["method"]) for r in readers.clover_tests(spark, path).collect()] == [("UserTest", "testOne")]
    other = put(tmp_path, "none.xml", "<coverage><file name='q'/></coverage>")
    assert readers.clover_tests(spark, other).first()["method"] == "testGeneral"
    known = spark.createDataFrame([("x.xml", "<coverage", "clover"), ("x.cov", "", "cov"), ("x", "<?xml ", "clover"), ("x", "", "cov")], "name string, head string, want string")
    assert known.where(readers.format_of(F.col("name"), F.col("head")) != F.col("want")).isEmpty()


def test_junit(spark, tmp_path):
    path = put(tmp_path, "j.xml", '<testsuites><testsuite><testsuite><testcase name="a" class="C" time="0.5"/><testcase name="b" class="C" time="x"><failure>f</failure></testcase></testsuite></testsuite></testsuites>')
    got = sorted((r["path"], r["method"], r["exec_time_ms"], r["recent_fail_rate"]) for r in readers.junit_tests(spark, path).collect())
    assert got == [("C", "a", 500.0, 0.0), ("C", "b", 0.0, 1.0)]


def test_feedback_log(spark, tmp_path):
    log = put(tmp_path, "f.log", '{"cluster_id": 1, "action": "keep"}\n\nbroken\n{"cluster_id": 1, "action": "merge"}\n')
    rows = readers.feedback_log(spark, log)
    assert [(r["cluster_id"], r["action"]) for r in store.latest_feedback(rows).collect()] == [(1, "merge")]
    sinks.append_feedback(spark, str(tmp_path / "fb"), 3, "keep", "r", "2024-01-01")
    assert readers.feedback_log(spark, str(tmp_path / "fb")).first()["cluster_id"] == 3
    with pytest.raises(ValueError):
        sinks.append_feedback(spark, str(tmp_path / "fb"), 3, "other", "r", "t")


def test_runs_can_be_deleted(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame([(1, "2024-01-01"), (2, "2025-01-01")], "id long, created_at string").write.parquet(path)
    assert sinks.delete_older_than(spark, path, "2024-06-01") == 1
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [2]


@pytest.fixture
def found(spark):
    rows = [(1, 10, [11, 12], 0.96, "high", "Remove <b>", 1.5), (2, 20, [21], 0.86, "medium", "Consider", 0.5)]
    return spark.createDataFrame(rows, "cluster_id long, representative long, redundant_tests array<long>, score double, priority string, recommendation string, seconds_saved double")


@pytest.mark.parametrize("fmt", ["json", "yaml", "markdown", "md", "html"])
def test_reports(spark, found, tmp_path, fmt):
    path = tmp_path / "report"
    sinks.save_findings(found, findings.report_counts(found), fmt, str(path))
    text = path.read_text()
    assert "Remove" in text and text.index("Remove") < text.index("Consider")
    if fmt == "json":
        assert [f["cluster_id"] for f in json.loads(text)] == [1, 2]
    if fmt == "html":
        assert "<b>" not in text and "&lt;b&gt;" in text
    with pytest.raises(ValueError):
        sinks.save_findings(found, findings.report_counts(found), "pdf", str(path))


def test_settings():
    assert Settings().with_overrides({"threshold": 0.5, "unknown": 1}).threshold == 0.5
    for bad in ({"algorithm": "x"}, {"threshold": 2.0}, {"output_format": "pdf"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert PRESETS["strict"].threshold > PRESETS["lenient"].threshold
    with pytest.raises(ValueError):
        pipeline.create("nothing")


@pytest.mark.parametrize("algorithm", ["kmeans", "dbscan", "hierarchical"])
def test_whole_run(spark, algorithm):
    words = ["login", "logout", "invoice", "refund"]
    sources = [(i, f"function test_{words[i % 4]}() {{ ${words[i % 4]}Value = 1; $this->assertEquals('{words[i % 4]} works', $x->get{words[i % 4].title()}()); }}") for i in range(24)]
    lines = [(i, f"src/{words[i % 4]}.php", n) for i in range(24) for n in range(10)]
    tests = [(i, "Suite", f"{words[i % 4]}_{i}", 5.0) for i in range(24)]
    settings = Settings(algorithm=algorithm, semantic_dim=16, n_clusters=4, eps=0.3, min_samples=3, max_clusters=6)
    result = pipeline.run(
        spark, spark.createDataFrame(sources, "id long, source string"), spark.createDataFrame(lines, "test_case_id long, file string, line int"), spark.createDataFrame(tests, "id long, path string, method string, exec_time_ms double"), settings
    )
    found = result.findings.collect()
    assert len(found) == 4 and all(f["score"] > 0.99 and len(f["redundant_tests"]) == 5 for f in found)
    assert {r["level"]: r["tests"] for r in result.summary.collect()}["very_high_redundancy"] == 24


def test_stream_counts_a_fact_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"test_run_id": 1, "test_case_id": 2, "file": "a", "line": 3, "seen_at": "2024-01-01T00:00:00Z"}
    put(folder, "1.json", json.dumps(row) + "\n" + json.dumps(row) + "\n")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.write_facts(ingest.coverage_stream(spark, str(folder)), out, check).awaitTermination(60)
    put(folder, "2.json", json.dumps(row | {"line": 4}) + "\n")
    ingest.write_facts(ingest.coverage_stream(spark, str(folder)), out, check).awaitTermination(60)
    assert sorted(r["line"] for r in spark.read.parquet(out).collect()) == [3, 4]
    known = spark.createDataFrame([(1, "keep", "", "2024-01-01")], "cluster_id long, action string, reason string, timestamp string")
    batch = spark.createDataFrame([(1, "merge", "", "2024-01-02")], known.schema)
    assert ingest.latest_feedback(batch, known).select(F.col("action")).first()["action"] == "merge"


def test_feedback_can_be_compacted_cleared_and_moved(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for cluster, action, at in ((1, "keep", "2024-01-01"), (1, "merge", "2024-01-02"), (2, "ignore", "2024-01-01")):
        sinks.append_feedback(spark, log, cluster, action, "r", at)
    sinks.compact_feedback(spark, log)
    assert sorted((r["cluster_id"], r["action"]) for r in spark.read.json(log).collect()) == [(1, "merge"), (2, "ignore")]
    sinks.export_feedback(spark, log, out)
    sinks.clear_feedback(spark, log, 2)
    assert [r["cluster_id"] for r in sinks.read_feedback(spark, log).collect()] == [1]
    sinks.import_feedback(spark, log, out)
    assert sinks.read_feedback(spark, log).count() == 2
    put(tmp_path, "bad.json", '{"x": 1}\n')
    with pytest.raises(ValueError):
        sinks.import_feedback(spark, log, str(tmp_path / "bad.json"))
    sinks.clear_feedback(spark, log)
    assert not (tmp_path / "log").exists()


def test_runs_can_be_changed(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, git_commit_hash string").write.parquet(path)
    sinks.update_run(spark, path, 2, git_commit_hash="c")
    assert sorted((r["id"], r["git_commit_hash"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_code_of_tests(spark):
    tests = spark.createDataFrame([(1, "App\\Test", "one"), (2, "a.php", "two")], "id long, path string, method string")
    files = spark.createDataFrame([("a.php", "class A { function two() { $this->go(); } }")], "path string, content string")
    got = {r["id"]: r["source"] for r in readers.test_code(tests, files).collect()}
    assert got == {1: "test_method one class App\\Test method one", 2: "test_method two function call_two call_go"}
    with pytest.raises(Exception, match="test file not found"):
        readers.test_code(tests.where("id = 2"), files.where("false")).collect()
    with pytest.raises(ValueError, match="missing columns: x"):
        readers.require_columns(tests, ["id", "x"])


def test_results_and_vectors(spark, tmp_path):
    members = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "cluster_id long, id long, name string")
    pairs = spark.createDataFrame([(0, 1, 2, 0.9)], "grp long, a long, b long, score double")
    result = pipeline.Result(members, findings.redundant_tests(members, pairs), None, None, None)
    vectors = spark.createDataFrame([("a", [1.0])], "name string, value array<double>")
    sinks.save_results(result, spark.range(1), {"algorithm": "kmeans"}, str(tmp_path / "r"), vectors)
    assert sorted(x.name for x in (tmp_path / "r").iterdir()) == ["clusters.json", "redundancy_report.csv", "results.json", "vectors.json"]
    report = spark.read.csv(str(tmp_path / "r/redundancy_report.csv"), header=True).collect()
    assert {(r["test"], r["max_similarity"]) for r in report} == {("1", "90.0%"), ("2", "90.0%")}
    assert readers.vectors(spark, put(tmp_path, "v.json", '{"a": [1, 2.5]}')).first()["v"] == [1.0, 2.5]

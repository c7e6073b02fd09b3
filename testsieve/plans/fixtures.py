"""The benchmark tables as test-suite facts. Each relation is one SQL text over tables, read by both engines, so that a query
and the SQL that it is held against begin from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL; {x} is a table or another relation.
RELATIONS = {
    "runs": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS git_commit_hash, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR(10)) AS executed_at,
               CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR(10)) AS created_at
        FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY n_nationkey, n_name""",
    "fails": """
        SELECT o_custkey AS test_id, avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS rate
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    "tests": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS test_run_id, c_mktsegment AS path, c_name AS method,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS exec_time_ms, f.rate AS recent_fail_rate
        FROM {customer} LEFT JOIN {fails} f ON f.test_id = c_custkey""",
    "lines": """
        SELECT DISTINCT o_custkey AS test_case_id, p_brand AS file, l_partkey AS line
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "dense": "SELECT DISTINCT user_id AS test_case_id, event_type AS file, CAST(hour(ts) AS BIGINT) AS line FROM {events}",
    "shared": """
        SELECT DISTINCT user_id AS test_case_id, event_type AS file,
               CASE WHEN event_type IN ('purchase', 'view') THEN CAST(floor(hour(ts) / 4) AS BIGINT) ELSE CAST(hour(ts) AS BIGINT) END AS line FROM {events}""",
    "requested": "SELECT DISTINCT user_id AS id FROM {events}",
    "changes": "SELECT DISTINCT p_brand AS file, p_partkey AS line FROM {part} WHERE p_size <= 10",
    "data_sets": """
        SELECT o_orderkey AS id, concat(c_mktsegment, '::', c_name,
               CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN concat(' with data set #', CAST(o_orderkey % 3 AS VARCHAR(20)))
                    WHEN 1 THEN concat(' with data set "', o_orderpriority, '"') WHEN 2 THEN ' (a, b)' ELSE '' END) AS name,
               CAST(o_totalprice AS DOUBLE) AS exec_time_ms
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "snippets": """
        SELECT p_partkey AS id, concat('<?php // covers ', p_name, chr(10), 'class ', CASE WHEN p_size % 2 = 0 THEN 'PartStore' ELSE 'PartTest' END,
               ' extends TestCase ', chr(123), ' /* ', p_type, chr(10), ' */', chr(10), 'public function test_', lower(p_type), '_price(int $partId) ', chr(123), ' $', replace(p_name, ' ', 'Of'),
               ' = new ', 'Size', CAST(p_size AS VARCHAR(10)), '("', p_brand, '"); if ($user == ', CAST(p_size AS VARCHAR(10)), ') ', chr(123), ' $this->assertEquals("', p_name, '", $mock->getLabel()); ', chr(125),
               ' # ', p_brand, chr(10), 'return expectTrue($status); ', chr(125), ' ', chr(125)) AS source FROM {part}""",
    "names": """
        SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS cluster_id, concat('test_',
               CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'success' WHEN 1 THEN 'fail' WHEN 2 THEN 'valid' WHEN 3 THEN 'create' WHEN 4 THEN 'delete'
                    WHEN 5 THEN 'max limit' WHEN 6 THEN 'throws exception' WHEN 7 THEN 'assertOk' ELSE 'returns null' END, '_', replace(p_name, ' ', '_'), '_', lower(p_type)) AS name
        FROM {part}""",
    "paths": """
        SELECT p_partkey AS id, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN concat('/app/', p_type, '/', replace(p_name, ' ', ''), 'Test.php') WHEN 1 THEN concat('App', chr(92), p_type, '::test_', replace(p_name, ' ', '_'))
               WHEN 2 THEN concat('Suite#', lower(p_type)) WHEN 3 THEN concat('Suite@', lower(p_type)) WHEN 4 THEN concat('/var/app/vendor/', p_type, '.php') WHEN 5 THEN concat('src', chr(92), 'src', chr(92), p_type, '.php')
               ELSE concat('tests/Unit/', p_type) END AS path FROM {part}""",
    "report": """
        SELECT CAST(o_custkey % 50 AS BIGINT) AS source, o_orderkey * 10 + l_linenumber AS pos,
               CASE WHEN l_linenumber = 1 THEN concat('TEST: case_', CAST(o_custkey % 11 AS VARCHAR(20))) WHEN l_linenumber = 3 THEN '   ' WHEN l_linenumber = 5 THEN 'junk'
                    ELSE concat('src/', l_returnflag, '.php:', CAST(l_partkey AS VARCHAR(20))) END AS text
        FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) JOIN {orders} ON o_orderkey = l_orderkey""",
    "feedback": "SELECT event_id AS pos, user_id AS cluster_id, CASE event_type WHEN 'error' THEN 'ignore' WHEN 'view' THEN 'keep' WHEN 'purchase' THEN 'merge' ELSE event_type END AS action, props AS reason FROM {events}",
    "scores": """
        SELECT o_orderkey AS id, o_totalprice / 500000e0 AS score, CAST(o_custkey % 14 AS BIGINT) AS redundant, o_totalprice / 1000e0 AS seconds, (o_totalprice / 5000e0) AS overlap FROM {orders}""",
    "vectors": "SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster_id, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}",
    "terms": "SELECT doc_id AS id, text AS source FROM {documents}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or relation as a DataFrame."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name != "documents":
            return df
        # long texts in a file of a few splits: dealt out, so that the expressions over them use all cores; else read in place
        cores = min(spark.sparkContext.defaultParallelism, 32)
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    sql = RELATIONS[name].replace("VARCHAR(10)", "STRING").replace("VARCHAR(20)", "STRING").replace("DOUBLE[]", "ARRAY<DOUBLE>")
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in set(_NAME.findall(sql))})


def ctes(*names: str) -> str:
    """`WITH` and the relations, with what they need, for the SQL side; ends where the query or another relation goes on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in TABLES and name not in order:
            for n in _NAME.findall(RELATIONS[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({_NAME.sub(lambda m: m[1], RELATIONS[n])})" for n in order)

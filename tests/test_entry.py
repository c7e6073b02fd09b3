from __future__ import annotations

import __spark_entry__
import bench


def test_flagship_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["run_id", "a", "b", "common", "jaccard", "uniqueness_a", "uniqueness_b", "level"] and df.count() > 0


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    corpus = {n for n in bench.HEADLINE if n.startswith("op") or n == "pipeline"}
    assert set(bench.HEADLINE) - corpus <= set(queries)
    # the corpus operators come together or not at all
    assert corpus <= set(queries) or not corpus & set(queries)

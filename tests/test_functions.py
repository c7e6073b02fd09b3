from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from testsieve.functions import metadata as M
from testsieve.functions import scoring as S
from testsieve.functions import text as T
from testsieve.functions import vectors as X


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_comments_go_in_order(spark):
    code = "a // b\nc /* d\ne */ f # g\nh"
    assert one(spark, T.strip_comments(F.col("c")), c=code) == "a \nc  f \nh"


def test_tokens_of_all_families(spark):
    code = """class UserTest { function testUserLogin() { $userName = 'long text'; $this->assertTrue($x->getAll()); } } class Mailer {}"""
    tokens = one(spark, T.raw_tokens(F.col("c")), c=code)
    assert tokens == ["testUserLogin", "Mailer", "assertTrue", "getAll", "assertTrue", "test", "userName", "this", "long text"]
    out = one(spark, T.tokenize(F.col("c")), c=code)
    assert "login" in out and "this" not in out and "user" in out


def test_empty_source_has_no_tokens(spark):
    assert one(spark, T.tokenize(F.col("c")), c="") == []


@pytest.mark.parametrize(("path", "name"), [("a/UserTest.php", "UserTest"), ("A::m", "m"), ("A#m", "m"), ("A@m", "m"), ("x/y", "y"), ("", None)])
def test_names(spark, path, name):
    assert one(spark, T.test_name(F.col("c")), c=path) == name


def test_identifier_is_cut_at_the_first_colons(spark):
    path, method = T.split_identifier(F.col("c"))
    assert one(spark, F.struct(path.alias("p"), method.alias("m")), c="A::b::c") == ("A", "b::c")
    assert one(spark, F.struct(path.alias("p"), method.alias("m")), c="x") == ("Unknown", "x")


def test_method_body_ends_with_its_brace(spark):
    code = "class A { public function f() { if (x) { y(); } } function g() { z(); } }"
    assert one(spark, T.method_body(F.col("c"), F.lit("f")), c=code) == "public function f() { if (x) { y(); } }"
    assert one(spark, T.method_body(F.col("c"), F.lit("none")), c=code) == ""


@pytest.mark.parametrize(("name", "base"), [("A::t with data set #3", "A::t"), ('A::t with data set "x y"', "A::t"), ("A::t (1, 2)", "A::t"), ("A::t", "A::t")])
def test_normalized_names(spark, name, base):
    assert one(spark, M.normalized_name(F.col("c")), c=name) == base


@pytest.mark.parametrize(("path", "method", "kind"), [("tests/Feature/X", "t", "integration"), ("tests/Unit/X", "t", "unit"), ("E2E", "t", "e2e"), ("x", "apiCall", "api"), ("x", "t", "unit")])
def test_kinds(spark, path, method, kind):
    assert one(spark, M.test_kind(F.col("p"), F.col("m")), p=path, m=method) == kind


def test_complexity_skips_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, M.complexity(null, null, F.lit("e2e")), c=1) == 0.4
    assert one(spark, M.complexity(F.lit(2000.0), F.lit(50), F.lit("unit")), c=1) == pytest.approx(0.53)


def test_scores(spark):
    score = F.col("s")
    assert one(spark, S.level(score), s=0.86) == "very_high_redundancy"
    assert one(spark, S.level(score), s=0.1) == "no_redundancy"
    assert one(spark, S.priority(score, F.lit(5)), s=0.2) == "medium"
    assert one(spark, S.action(score), s=0.96) == "merge"
    assert one(spark, S.impact(score), s=0.49) == "low"
    assert one(spark, S.numeric_priority(F.lit("high"), score, F.lit(30), F.lit(5000.0)), s=0.5) == 140
    assert one(spark, S.rationale(score, F.lit(12), F.lit(11.0), F.lit(95.0)), s=0.97)[0].startswith("Tests are 97%")
    assert one(spark, S.bytes_text(F.lit(2048)), s=1) == "2.00 KB"
    assert one(spark, S.duration_text(F.lit(61000.0)), s=1) == "1m 1s"


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, X.cosine(a, b), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)
    assert one(spark, X.cosine(a, b), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, X.combined(a, b, b, b)["combined"], a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx(0.3)
    assert one(spark, X.l2_normalize(a), a=[3.0, 4.0], b=[0.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, X.l2_normalize(a), a=[0.0, 0.0], b=[0.0]) == [0, 0]
    assert one(spark, X.min_max(a), a=[2.0, 2.0], b=[0.0]) == [0, 0]
    assert one(spark, X.standardize(a), a=[1.0, 3.0], b=[0.0]) == [-1, 1]
    assert one(spark, X.entropy_values(a), a=[1.0, -1.0], b=[0.0]) == pytest.approx(1)
    assert one(spark, X.entropy_values(a), a=[0.0, 0.0], b=[0.0]) == 0
    assert one(spark, X.jaccard(a, b), a=[1, 2], b=[2, 3]) == pytest.approx(1 / 3)

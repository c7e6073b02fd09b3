"""Column expressions over test cases: normalized names, kinds, complexity and the metadata record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a kind of test weighs in the complexity score.
KIND_WEIGHTS = {"unit": 0.2, "integration": 0.6, "api": 0.8, "e2e": 1.0}


def identifier(path: Column, method: Column) -> Column:
    return F.concat_ws("::", path, method)


def line_key(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def normalized_name(name: Column) -> Column:
    """A test's identifier without what tells its data sets apart."""
    # fixed values: how runners write data sets
    for pattern in (r""" with data set ["']?[^"']*["']?$""", r" with data set #[0-9]+$", r"\s*\([^)]*\)\s*$"):
        name = F.regexp_replace(name, pattern, "")
    return name


def is_parameterized(name: Column) -> Column:
    return normalized_name(name) != name


def test_kind(path: Column, method: Column) -> Column:
    path, method = F.lower(path), F.lower(method)

    def has(col: Column, *parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(col, F.lit(p))
        return out

    return (
        F.when(has(path, "integration", "feature") | has(method, "integration"), "integration")
        .when(has(path, "unit") | has(method, "unit"), "unit")
        .when(has(path, "e2e", "endtoend") | has(method, "e2e"), "e2e")
        .when(has(path, "api") | has(method, "api", "endpoint"), "api")
        .otherwise("unit")
    )


def complexity(exec_time_ms: Column, lines: Column, kind: Column, digits: int = 3) -> Column:
    """0.3 for a second or more, 0.3 for 100 lines or more, 0.4 for the kind; what is null adds nothing."""
    weight = F.lit(KIND_WEIGHTS["unit"])
    for k, w in KIND_WEIGHTS.items():
        weight = F.when(kind == k, w).otherwise(weight)
    # least() passes over nulls, so they are asked for
    time = F.when(exec_time_ms.isNull(), 0.0).otherwise(F.least(F.lit(1.0), exec_time_ms / 1000) * 0.3)
    covered = F.when(lines.isNull(), 0.0).otherwise(F.least(F.lit(1.0), lines / 100) * 0.3)
    return F.round(time + covered + weight * 0.4, digits)

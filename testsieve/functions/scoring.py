"""Column expressions that turn scores into levels, priorities, actions, texts and savings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redundancy levels with the least similarity of each, strongest first (pipeline defaults).
LEVELS = {"very_high_redundancy": 0.85, "high_redundancy": 0.7, "moderate_redundancy": 0.5, "low_redundancy": 0.3}
NO_REDUNDANCY = "no_redundancy"
ALL_LEVELS = [*LEVELS, NO_REDUNDANCY]

HIGH, MEDIUM = 0.95, 0.85


def _steps(value: Column, steps: list[tuple[float, str]], other: str) -> Column:
    out = F.lit(other)
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def level(similarity: Column, levels: dict[str, float] = LEVELS) -> Column:
    return _steps(similarity, [(v, k) for k, v in levels.items()], NO_REDUNDANCY)


def priority(score: Column, redundant: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when((score >= high) | (redundant >= 10), "high").when((score >= medium) | (redundant >= 5), "medium").otherwise("low")


def priority_rank(name: Column) -> Column:
    return F.when(name == "high", 0).when(name == "medium", 1).otherwise(2)


def action(score: Column) -> Column:
    return _steps(score, [(0.95, "merge"), (0.85, "consolidate"), (0.70, "review")], "monitor")


def impact(score: Column) -> Column:
    return _steps(score, [(0.9, "critical"), (0.7, "high"), (0.5, "medium")], "low")


def numeric_priority(name: Column, score: Column, redundant: Column, seconds_saved: Column) -> Column:
    base = F.when(name == "high", 100).when(name == "medium", 50).when(name == "low", 10).otherwise(0)
    return base + score * 20 + F.least(redundant * 2, F.lit(20)) + F.least(seconds_saved / 100, F.lit(10.0))


def percent(score: Column) -> Column:
    """A share as a whole percentage."""
    return F.floor(score * 100 + 0.5).cast("int")


def one_decimal(x: Column) -> Column:
    """Rounded half up in binary arithmetic, so that engines agree on ties."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


# The sentences of recommendations and rationales.
def recommendation(score: Column, redundant: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    p, n = percent(score), redundant.cast("string")
    return (
        F.when(score >= high, F.concat(F.lit("Remove "), n, F.lit(" highly redundant tests ("), p, F.lit("% similar). Keep only the representative test for this functionality.")))
        .when(score >= medium, F.concat(F.lit("Consider consolidating "), n, F.lit(" similar tests ("), p, F.lit("% overlap). Review for potential merge or parameterization opportunities.")))
        .otherwise(F.concat(F.lit("Review "), n, F.lit(" related tests for optimization opportunities. Minor redundancy detected ("), p, F.lit("% similarity).")))
    )


def rationale(score: Column, redundant: Column, seconds_saved: Column, overlap: Column) -> Column:
    """Up to four sentences that give a recommendation's grounds."""
    p, n = percent(score), redundant.cast("string")
    return F.filter(
        F.array(
            F.when(score >= 0.95, F.concat(F.lit("Tests are "), p, F.lit("% similar, indicating nearly identical functionality"))).when(
                score >= 0.85, F.concat(F.lit("High similarity ("), p, F.lit("%) suggests significant overlap in test coverage"))
            ),
            F.when(redundant >= 10, F.concat(F.lit("Large number of redundant tests ("), n, F.lit(") amplifies impact"))).when(
                redundant >= 5, F.concat(F.lit("Multiple redundant tests ("), n, F.lit(") offer consolidation opportunity"))
            ),
            F.when(seconds_saved > 10, F.concat(F.lit("Removing redundant tests would save "), one_decimal(seconds_saved), F.lit("s per test run"))),
            F.when(overlap > 90, F.concat(F.lit("Tests have "), F.floor(overlap + 0.5), F.lit("% coverage overlap"))),
        ),
        lambda s: s.isNotNull(),
    )


def duration_text(ms: Column) -> Column:
    """Milliseconds, seconds, or minutes and seconds."""
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + 0.5), F.lit("ms")))
        .when(ms < 60000, F.concat(one_decimal(ms / 1000), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60000), F.lit("m "), F.floor(F.pmod(ms, F.lit(60000.0)) / 1000), F.lit("s")))
    )


def bytes_text(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one."""
    out, units = F.lit(None).cast("string"), ["B", "KB", "MB", "GB"]
    for i, unit in reversed(list(enumerate(units))):
        text = F.concat(F.format_string("%.2f", n / float(1024**i)), F.lit(f" {unit}"))
        out = text if i == len(units) - 1 else F.when(n < 1024 ** (i + 1), text).otherwise(out)
    return out

"""Connected components of an edge list, by alternating large and small stars.

Every round is two aggregations and two joins on the edges and ends in the shared folder, so lineage stays short and a lost
executor costs one round at most. No neighbourhood is gathered: minima are pre-aggregated before the shuffle and the joins
can be split by the adaptive planner where a node has very many neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    sym = edges.select("u", "v")
    if both:
        sym = sym.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = sym.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable; nodes without edges don't appear.

    Self loops, repeated edges and null ends are ignored; an empty list gives an empty frame."""
    state, now = None, cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        found = _state(now)
        if found == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
        then = cut(_star(_star(now, True), False), "edges")
        drop_cut(now)
        now = then

"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, in which the centres of large stars are joined apart; rounds grow with the logarithm of the longest chain. Each
round's edges are written to the shared folder, so a lost executor costs one round at most; the round before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import attach, discard, materialize


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return attach(both, least, "u", "n", 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    to_least = attach(down, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.union(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """vertex, root for every vertex that is not its component's smallest. edges: u, v (bigint), u <> v. known: the result of
    an earlier run, to whose components the edges are added; its stars take the place of the edges they came from."""
    edges = edges.where("u <> v")
    if known is not None:
        edges = edges.union(known.select("vertex", "root"))
    edges = materialize(edges.distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        large = materialize(_large_star(edges, before[0]), "edges")
        last, edges = edges, materialize(_small_star(large, before[0]), "edges")
        discard(last, large)
        now = _signature(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    found._isobarn_files = edges._isobarn_files  # for discard
    return found

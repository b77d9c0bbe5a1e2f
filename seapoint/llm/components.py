"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.staging import scratch, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every vertex hands its (large: greater, small: smaller) neighbours its minimum.

    The minima are aggregated before the shuffle and staged, so a vertex with very many neighbours
    is joined in parts.
    """
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "minima")
    if large:
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct() if not large else staged(out.filter("a <> b").distinct(), "stars")


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (the smallest vertex reachable) for every vertex of ``edges(a, b)``.

    Ends when a round changes nothing; rounds grow with the logarithm of the longest path. Null ends and loops are ignored.
    """
    edges = staged(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == mark:
            break
        mark = (state.n, state.h)
        with scratch(edges.sparkSession) as kept:
            edges = kept(_stars(_stars(edges, large=True), large=False), "edges")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )

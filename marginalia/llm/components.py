"""Connected components of a link table, as a loop of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import kept


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node that can be reached.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then
    every node hands its smaller neighbours to its smallest one. The number of rounds grows with the logarithm of
    the longest chain. Minima are combined before the shuffle, and the joins back to the links can be split by
    Spark where one node has most of the links.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        # edges: (u, v), u > v
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionAll(turned) if larger else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u > v")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = kept(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = state(edges)
    for _ in range(max_rounds):
        edges = kept(star(star(edges, True), False).distinct())
        now = state(edges)
        if now == before:  # links that neither step changes go from every node to the root
            break
        before = now
    else:
        raise RuntimeError("links did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )

"""Connected components of a graph given by its edges, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id that it is connected to.

    Alternates large-star and small-star steps on the edges (Kiveris et al. 2014), O(log^2) rounds; each round is a
    table in the shared folder. No vertex's neighbours are ever gathered: the minimum is an aggregate. Ids may be of any
    type that has an order; a row with a null has no edge; links of an id to itself, repeated links and an empty table
    are as good as any.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null")
    alone = materialise(edges.filter("u = v").select("u").distinct())
    edges = materialise(edges.filter("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.filter("v < u")
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.filter("v > u" if large else "true").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        if not large:
            moved = moved.unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return moved.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = None
    while (now := mark(edges)) != last:
        last = now
        edges = materialise(star(materialise(star(edges, True)), False))
    named = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).unionByName(alone.select(F.col("u").alias("id")).join(edges.select("u"), F.col("id") == F.col("u"), "left_anti")).distinct()
    return named.unionByName(roots.withColumn("component", F.col("id")))

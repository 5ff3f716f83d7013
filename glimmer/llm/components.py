"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved


def _least(both: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included; both: (u, v) each way."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to its smallest one; edges have v < u."""
    least = _least(edges)
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component): the smallest node that each node of edges(u, v) reaches; nodes are long ids.

    Edges may come in either direction and repeated; those with a null and
    loops are left out, so a node that has only such edges isn't returned.  A
    step's minima are combined before the shuffle, and joined by the node, where
    Spark splits the edges of a node that has many.  The steps end when the
    edges are stars: every larger end appears once and no smaller end is one.
    """
    save = Saved(edges.sparkSession)
    now = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        large = save(_large_star(now))
        save.drop(now)
        now = save(_small_star(large))
        save.drop(large)
        twice = now.groupBy("u").count().where("count > 1")
        inner = now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi")
        if not twice.take(1) and not inner.take(1):
            return now.select("u", F.col("v").alias("component"))

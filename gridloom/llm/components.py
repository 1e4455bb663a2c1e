"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of an edge table (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the
    shared folder, so no round's loss repeats the ones before. Only distributed joins and
    pre-aggregated minima: no node's neighbours are ever gathered, and the join in which a large star
    meets its centre has written tables on both sides, so that Spark can split it. Self-loops, repeated
    and null-ended edges are ignored; an empty table gives an empty result. rows: about how many edges there
    are, for the number of files only.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = materialize(e, "edges", rows)
    while True:  # each round brings every node nearer to its smallest
        rows = e.count()
        # the smallest neighbour of each node that has a smaller one: others are their own minimum
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "least", rows)
        if least.count() == rows and e.join(least.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            drop_table(least)  # stars: every node hangs on one that is its own minimum
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        large = e.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(mins.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "stars", rows)
        drop_table(e)
        drop_table(least)
        e = after

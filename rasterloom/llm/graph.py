"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import drop_staged, stage

#: A node is a hub if it has more than 1 / HUBS of all edges, so there are fewer than 2 * HUBS of them.
HUBS = 256


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable. Any orderable type.

    Alternating large-star and small-star steps; each is one aggregation and one join on a node. Each step is written to
    the shared folder, which cuts the lineage.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n_now = now.count()
    for _ in range(most):
        # large star: all larger neighbours of a node point to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * n_now, F.least("a", F.min("b"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself point to the smallest
        small = _with_least(large, n_now, F.min("b"))
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least).distinct()
        new = stage(small, "links")
        n_new = new.count()
        same = n_new == n_now and new.join(now, ["a", "b"], "left_anti").isEmpty()
        drop_staged(now)
        now, n_now = new, n_new
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _with_least(rows: DataFrame, total: int, least: Column) -> DataFrame:
    """rows (a, b) with m, the least of each a. Rows of hubs, which one task can't hold, get it by broadcast; total: rows at most."""
    least = rows.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    bound = max(1, total // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bound).select("a", "m"))
    others = least.where(F.col("n") <= bound).select("a", "m")
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(others.hint("merge"), "a"))

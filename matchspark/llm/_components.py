"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm._tables import drop_kept, keep


def components(edges: DataFrame) -> DataFrame:
    """id and root of every vertex of edges (a, b): vertices have the same root if and only if a path joins them.

    Each round every vertex takes as parent the neighbour (or itself) of least
    hash, labels and edges move to the parents, and edges within one label go.
    The order by hash makes the graph shrink by a factor a round whatever its
    shape. Tables are written each round, so nothing is recomputed and no hot
    vertex is gathered: minima combine before the shuffle and joins may split.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("id"))
    one_way = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = keep(one_way(edges), "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m"), F.first(rank("a")).alias("s")).select("v", F.least("m", "s")["id"].alias("p"))
        parent = keep(parent, "parents")
        before = live
        step = live.hint("merge").join(parent, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b")
        step = step.hint("merge").join(parent, F.col("b") == F.col("v")).select("a", F.col("p").alias("b"))
        live = keep(one_way(step), "edges")
        drop_kept(before)
        if labels is None:
            labels = parent.select(F.col("v").alias("id"), F.col("p").alias("root"))
        else:
            moved = labels.hint("merge").join(parent, F.col("root") == F.col("v"), "left")
            moved = keep(moved.select("id", F.coalesce("p", "root").alias("root")), "labels")
            drop_kept(labels, parent)
            labels = moved
    if labels is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return labels

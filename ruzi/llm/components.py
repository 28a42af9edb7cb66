"""Connected components with DataFrame operations only.

Each round hooks every node to the least node among itself and its neighbours,
shortens the hooks by following them twice, replaces both ends of every edge by
what they hook to, and drops the edges that became loops.  The rounds end when no
edge is left; a component is named by its least node.

Scale: minima are combined before the shuffle, so a node with very many edges
costs one row per task, and joins on its key have a unique other side that lets
Spark split the large one.  Each round's tables are written to the shared folder, and
those of the round before are deleted.
Nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import discard, written


def hooks(edges: DataFrame) -> DataFrame:
    """node and parent: the least of a node and its neighbours, followed twice."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    parents = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")))
    up = parents.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
    followed = written(parents.join(up, F.col("parent") == F.col("mid")).select("node", F.col("top").alias("parent")))
    discard(parents)
    return followed


def components(edges: DataFrame) -> DataFrame:
    """node and component for every node of ``edges`` (columns u and v, nulls dropped).

    Repeated edges, loops and both directions are fine; no edges give no rows.
    """
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    first = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = written(first.select(F.col("u").alias("node")).union(first.select("v")).distinct().withColumn("component", F.col("node")))
    left = written(first.where(F.col("u") != F.col("v")))
    discard(first)
    while not left.isEmpty():
        parents = hooks(left)
        of_u = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        of_v = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = left.join(of_u, "u").join(of_v, "v").where(F.col("pu") != F.col("pv"))
        fewer = written(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        step = parents.select(F.col("node").alias("component"), "parent")
        named = written(
            labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        )
        discard(parents, left, labels)
        left, labels = fewer, named
    discard(left)
    return labels

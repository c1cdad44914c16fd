"""Connected components as joins and groupings; no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b), component being the smallest node it reaches.

    Each round, every component found so far that has links outwards hooks on to its smallest neighbour if that is smaller, or
    if no neighbour hooks on to it; there the neighbour leads to a smaller one yet. The forest of hooks is flattened by pointer
    jumping, and links within a component go. So the components that have links at least halve from round to round: n nodes
    take no more than log2(n) rounds, each of about log2(n) jumps. Every round is a written table. No links give no rows;
    links with a null end count for nothing; loops and repeated links do no harm.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    edges = written(links.union(links.select("b", "a")).distinct(), "edges")
    labels = None
    while True:
        near = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")), "near")
        hooked = near.where("near < node").select(F.col("near").alias("node"), F.lit(True).alias("hooked")).distinct()
        hooks = written(near.join(hooked, "node", "left").select("node", F.when(F.col("hooked"), F.least("node", "near")).otherwise(F.col("near")).alias("top")), "hooks")
        if hooks.isEmpty():
            return labels if labels is not None else hooks.withColumnRenamed("top", "component")
        while True:  # node to the top of its tree
            above = hooks.select(F.col("node").alias("top"), F.col("top").alias("next"))
            jumped = written(hooks.join(above, "top").select("node", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "hooks")
            hooks = jumped.select("node", "top")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.withColumnRenamed("top", "component")
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "component"), "component", "left")
            labels = written(moved.select("node", F.coalesce("top", "component").alias("component")), "labels")
        a = hooks.select(F.col("node").alias("a"), F.col("top").alias("top_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("top").alias("top_b"))
        edges = written(edges.join(a, "a").join(b, "b").where("top_a != top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), "edges")

"""Ways chained into roads by joins on their end nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def way_ends(ways: DataFrame) -> DataFrame:
    """(node, way, at_start) of the ends of ways (way, nodes), closed ways left out."""
    ends = ways.where(F.element_at("nodes", 1) != F.element_at("nodes", -1))
    return ends.select(
        "way",
        F.explode(
            F.array(
                F.struct(F.element_at("nodes", 1).alias("node"), F.lit(True).alias("at_start")),
                F.struct(F.element_at("nodes", -1).alias("node"), F.lit(False).alias("at_start"))
            )
        ).alias("e")
    ).select("e.node", "way", "e.at_start")


def pairs(ways: DataFrame) -> DataFrame:
    """(a, a_start, b, b_start): ends that join. ways: way, nodes, key, and dx0, dy0, dx1, dy1, the unit directions at start and end.

    Where exactly two ends of two ways meet, off all ways' interiors, they join. Elsewhere ends of one key join in turn, the straightest pair first; nodes have few ends.
    """
    ends = way_ends(ways)
    inner = ways.select(F.explode(F.slice("nodes", F.lit(2), F.greatest(F.lit(0), F.size("nodes") - 2))).alias("node")).distinct().withColumn("inner", F.lit(True))
    at = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("way").alias("lo"), F.max("way").alias("hi")).join(inner, "node", "left")
    simple = at.where("n = 2 AND lo != hi AND inner IS NULL").select("node")
    two = ends.join(simple, "node").groupBy("node").agg(F.min(F.struct("way", "at_start")).alias("a"), F.max(F.struct("way", "at_start")).alias("b"))
    two = two.select(F.col("a.way").alias("a"), F.col("a.at_start").alias("a_start"), F.col("b.way").alias("b"), F.col("b.at_start").alias("b_start"))
    rest = ends.join(simple, "node", "left_anti").join(ways.select("way", "key", "dx0", "dy0", "dx1", "dy1"), "way").where("key IS NOT NULL")
    rest = rest.select(
        "node", "key", "way", "at_start", F.when(F.col("at_start"), F.col("dx0")).otherwise(F.col("dx1")).alias("dx"),
        F.when(F.col("at_start"), F.col("dy0")).otherwise(F.col("dy1")).alias("dy")
    )

    return two.unionByName(straightest(rest))


def straightest(ends: DataFrame) -> DataFrame:
    """(a, a_start, b, b_start): ends (node, key, way, at_start, dx, dy, the direction outwards) paired at each node and key, the straightest pair of free ends first, and the first of
    equals in order of ways. A way is not paired with itself; an end that is left over stays alone.

    All pairs of a node and key stand in one order, and are taken in it while both ends are free. As a road's node has a handful of ends, that is one fold over a short list.
    """
    listed = ends.groupBy("node", "key").agg(F.array_sort(F.collect_list(F.struct("way", "at_start", "dx", "dy"))).alias("e"))
    pair = lambda u, v: F.struct((u.dx * v.dx + u.dy * v.dy).alias("bent"), F.struct(u.way, u.at_start).alias("a"), F.struct(v.way, v.at_start).alias("b"))
    after = lambda u: F.filter("e", lambda v: v.way > u.way)
    pairs_of = F.array_sort(F.flatten(F.transform("e", lambda u: F.transform(after(u), lambda v: pair(u, v)))))
    met = lambda t, p: (t.a == p.a) | (t.a == p.b) | (t.b == p.a) | (t.b == p.b)
    step = lambda taken, p: F.when(F.exists(taken, lambda t: met(t, p)), taken).otherwise(F.concat(taken, F.array(p)))
    with_pairs = listed.where(F.size("e") > 1).select(pairs_of.alias("p"))
    taken = with_pairs.select(F.explode(F.aggregate("p", F.slice("p", 1, 0), step)).alias("t"))
    return taken.select(F.col("t.a.way").alias("a"), F.col("t.a.at_start").alias("a_start"), F.col("t.b.way").alias("b"), F.col("t.b.at_start").alias("b_start"))


def chained(ways: DataFrame, links: DataFrame) -> DataFrame:
    """(way, road, pos, reversed): road is the least way of the chain; pos counts from the end that lies behind its start; reversed ways are entered at their end.

    Pointer jumping over the two sides of every way: each round doubles the ways that a pointer passes, so rounds grow with the logarithm of the
    longest chain, and every round is a written table. A ring is cut behind the start of its least way.
    """
    both = links.select("a", "a_start", "b", "b_start").union(links.select("b", "b_start", "a", "a_start"))
    # leaving a way by one side leads into the next by a side, to be left by its other
    after = both.select(F.col("a").alias("way"), F.col("a_start").alias("side"), F.col("b").alias("to"), (~F.col("b_start")).alias("to_side"))
    sides = ways.select("way", F.explode(F.array(F.lit(True), F.lit(False))).alias("side"))
    p = sides.join(after, ["way", "side"], "left").select(
        "way", "side", F.coalesce("to", "way").alias("to"), F.coalesce("to_side", "side").alias("to_side"),
        F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("way", F.coalesce("to", "way")).alias("least")
    )
    p, span, n = stored(p, "pointers"), 1, ways.count()
    while True:
        q = p.select(
            F.col("way").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("to2"), F.col("to_side").alias("side2"),
            F.col("steps").alias("more"), F.col("least").alias("least2")
        )
        p = stored(
            p.join(q, ["to", "to_side"]).select(
                "way", "side", F.col("to2").alias("to"), F.col("side2").alias("to_side"), (F.col("steps") + F.col("more")).alias("steps"),
                F.least("least", "least2").alias("least"), (F.col("more") > 0).alias("moved")
            ),
            "pointers"
        )
        span *= 2
        if p.where("moved").isEmpty() or span > 2 * n:
            break
        p = p.drop("moved")
    # pointers that still move are on rings
    rings = p.where("moved").groupBy("way").agg(F.min("least").alias("road"))
    still = p.where("NOT moved")
    road = still.groupBy("way").agg(F.min("least").alias("road"))
    root = still.join(road, "way").where("way = road AND side").select("road", F.col("to").alias("root"), F.col("to_side").alias("root_side"))
    open_ = still.join(road, "way").join(root, "road").where("to = root AND to_side = root_side").select(
        "way", "road", F.col("steps").alias("pos"), (~F.col("side")).alias("reversed")
    )
    rings = stored(rings, "rings")
    if rings.isEmpty():
        return open_
    cut = rings.where("way = road").select("way")
    left = links.join(cut, (F.col("way") == F.col("a")) & F.col("a_start") | (F.col("way") == F.col("b")) & F.col("b_start"), "left_anti")
    inner = left.join(rings.select(F.col("way").alias("a")), "a", "left_semi").select("a", "a_start", "b", "b_start")
    return open_.unionByName(chained(rings.select("way"), inner))

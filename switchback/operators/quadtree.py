"""Boxes as cells of a quadtree, so that overlap and cover are equi-joins with a bound on the rows of a box.

A box is covered by at most side * side cells of one level, however large it is. Two boxes that overlap have cells of which one is the other or an ancestor of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: The finest level: cells of some 20 m.
LEVELS = 21


def _unit(lon: Column, lat: Column) -> tuple[Column, Column]:
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 1e-12), v))
    return clamp((lon + 180) / 360), clamp((lat + 90) / 180)


def _key(level: Column, x: Column, y: Column) -> Column:
    """A level and a cell's place on it as one number."""
    return F.shiftleft(level.cast("long"), 2 * LEVELS).bitwiseOR(F.shiftleft(x.cast("long"), LEVELS)).bitwiseOR(y.cast("long"))


def curve(lon: Column, lat: Column) -> Column:
    """A point's place on the Z-shaped curve through all cells of the finest level: the bits of both axes in turn, so that neighbours are mostly close."""
    bits = []
    for axis in _unit(lon, lat):
        v = F.floor(axis * (1 << LEVELS))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        bits.append(v)
    return F.shiftleft(bits[1], 1).bitwiseOR(bits[0])


def level_of(w: Column, s: Column, e: Column, n: Column, side: int) -> Column:
    """The finest level on which a box touches at most ``side`` cells along either axis."""
    span = F.greatest((e - w) / 360, (n - s) / 180)
    fits = F.floor(F.log2((side - 1) / F.greatest(span, F.lit(1e-12))) - 1e-9)
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), fits)).cast("int")


def cover(w: Column, s: Column, e: Column, n: Column, side: int = 8) -> Column:
    """The cells that cover a box, at most side * side, all of one level; null for a box with a null edge, none if its edges are the wrong way round."""
    (x0, y0), (x1, y1), level = _unit(w, s), _unit(e, n), level_of(w, s, e, n, side)
    place = lambda v: F.floor(v * F.pow(F.lit(2.0), level))
    xs, ys = F.sequence(place(x0), place(x1)), F.sequence(place(y0), place(y1))
    cells = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: _key(level, x, y))))
    return F.when((e < w) | (n < s), F.array().cast("array<bigint>")).otherwise(cells)


def above(cells: Column) -> Column:
    """The strict ancestors of cells of one level, each once."""
    level = F.shiftright(F.get(cells, F.lit(0)), 2 * LEVELS).cast("int")
    mask = F.lit((1 << LEVELS) - 1)
    part = lambda c, bits: F.shiftright(c, bits).bitwiseAND(mask)
    up = lambda c, k: _key(level - k, F.call_function("shiftright", part(c, LEVELS), k), F.call_function("shiftright", part(c, 0), k))
    ups = F.when(level > 0, F.sequence(F.lit(1), level)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(ups, lambda k: F.array_distinct(F.transform(cells, lambda c: up(c, k)))))


def in_cells(df: DataFrame, w: str, s: str, e: str, n: str, side: int, up: bool = True) -> DataFrame:
    """df once for each cell of a box's cover (own) and, if asked, each ancestor (not own): cell, own."""
    cells = df.withColumn("cells", cover(F.expr(w), F.expr(s), F.expr(e), F.expr(n), side))
    own = F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("own")))
    rest = F.transform(above(F.col("cells")), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
    return cells.withColumn("at", F.explode(F.concat(own, rest) if up else own)).select(*df.columns, "at.*")


def overlapping(left: DataFrame, right: DataFrame, condition: str = "true", side: int = 4) -> DataFrame:
    """The rows of left (w, s, e, n, and others) whose box meets that of a row of right (r_w, r_s, r_e, r_n, and others, none named as in left), edges counting, where the condition holds too.

    Neither boxes nor pairs are listed without a bound: a box makes at most side * side rows and their ancestors, and left rows leave the join at their first match. A null edge
    meets nothing.
    """
    numbered = stored(left.withColumn("row_", F.monotonically_increasing_id()), "boxes")
    # one of the two cells is a box's own; that is part of the key, or all boxes would be tried on each other in the coarsest cells
    own, other = F.array(F.lit("own"), F.lit("other")), F.array(F.lit("own"))
    at = in_cells(numbered, "w", "s", "e", "n", side).withColumn("as", F.when(F.col("own"), "own").otherwise("other"))
    to = in_cells(right, "r_w", "r_s", "r_e", "r_n", side).withColumn("r_as", F.explode(F.when(F.col("own"), own).otherwise(other))).withColumnsRenamed({"cell": "r_cell"}).drop("own")
    meets = (F.col("cell") == F.col("r_cell")) & (F.col("as") == F.col("r_as")) & F.expr(f"w <= r_e AND e >= r_w AND s <= r_n AND n >= r_s AND ({condition})")
    return at.join(to, meets, "left_semi").dropDuplicates(["row_"]).select(*left.columns)


def uncovered(left: DataFrame, right: DataFrame, condition: str = "true", slack: float = 1e-6, side: int = 4) -> DataFrame:
    """The rows of left (w, s, e, n, and others) whose box lies in none of right's (r_w, r_s, r_e, r_n, and others), but for so much slack, where the condition holds.

    A box that covers another holds its middle: left's middles meet right's cells through their ancestors, LEVELS + 1 rows a box at most.
    """
    x, y = _unit((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2)
    levels = F.array(*(_key(F.lit(k), F.floor(x * (1 << k)), F.floor(y * (1 << k))) for k in range(LEVELS + 1)))
    middles = stored(left.withColumn("row_", F.monotonically_increasing_id()), "boxes")  # written, so that its numbers stay
    to = in_cells(
        right.select(*right.columns, *(F.expr(f"{v} {sign} {slack}D").alias(f"wide_{v}") for v, sign in (("r_w", "-"), ("r_s", "-"), ("r_e", "+"), ("r_n", "+")))),
        "wide_r_w", "wide_r_s", "wide_r_e", "wide_r_n", side, up=False
    )
    inside = F.expr(f"r_s <= s + {slack}D AND r_w <= w + {slack}D AND r_n >= n - {slack}D AND r_e >= e - {slack}D AND ({condition})")
    found = middles.withColumn("at", F.explode(levels)).join(to, (F.col("at") == F.col("cell")) & inside, "left_semi").select("row_").distinct()
    return middles.join(found, "row_", "left_anti").select(*left.columns)

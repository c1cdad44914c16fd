"""Elevation of points from terrain tiles, by an equi-join on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import pixel_x, pixel_y
from ..sources.terrain import read_terrain
from ..storage import stored


def four_cells(points: DataFrame) -> DataFrame:
    """points (lon, lat, ...) once for each of the four terrain cells around them: x, y (the tile), cell, weight."""
    p = points.withColumns({"px": pixel_x(F.col("lon")), "py": pixel_y(F.col("lat"))})
    p = p.withColumns({"x0": F.floor("px"), "y0": F.floor("py")}).withColumns({"fx": F.col("px") - F.col("x0"), "fy": F.col("py") - F.col("y0")})
    share = lambda c, far: F.col(c) if far else 1 - F.col(c)
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("cx"), (F.col("y0") + dy).alias("cy"), (share("fx", dx) * share("fy", dy)).alias("weight"))
    four = p.withColumn("c", F.explode(F.array(*(corner(dx, dy) for dx in (0, 1) for dy in (0, 1))))).select(*points.columns, "c.*")
    cell = F.col("cy").bitwiseAND(255) * 256 + F.col("cx").bitwiseAND(255)
    return four.withColumns({"x": F.shiftright("cx", 8).cast("int"), "y": F.shiftright("cy", 8).cast("int"), "cell": cell.cast("int")}).drop("cx", "cy")


def needed_tiles(points: DataFrame) -> DataFrame:
    """(x, y) of the terrain tiles that elevation() needs for points (lon, lat), each once."""
    return four_cells(points.select("lon", "lat")).select("x", "y").distinct()


def elevation_of(points: DataFrame, path: str) -> DataFrame:
    """elevation() from a folder of PNG tiles, of which those that the points need are opened."""
    return elevation(points, read_terrain(points.sparkSession, path, needed_tiles(points)))


def elevation(points: DataFrame, terrain: DataFrame) -> DataFrame:
    """points (lon, lat, ...) with ele: between the four cells around each, of terrain tiles (x, y, metres: 256 rows of 256 cells). A tile that is not there is an error.

    A point meets one row, of the cell to its north-west with the metres of all four. There are such rows for the distinct cells that are needed, at most all of the terrain; a tile
    gives its own cells of them, and those at its edges get the others from the tiles beside it.
    """
    p = points.withColumns({"px": pixel_x(F.col("lon")), "py": pixel_y(F.col("lat"))}).withColumns({"cx": F.floor("px"), "cy": F.floor("py")})
    p = p.withColumns({"fx": F.col("px") - F.col("cx"), "fy": F.col("py") - F.col("cy")}).drop("px", "py")
    cell = (F.col("cy").bitwiseAND(255) * 256 + F.col("cx").bitwiseAND(255)).cast("int")
    needed = p.groupBy(F.shiftright("cx", 8).cast("int").alias("bx"), F.shiftright("cy", 8).cast("int").alias("by")).agg(F.collect_set(cell).alias("cells"))
    # a cell needs the tile to the east of its own in the last column, and the one to the south in the last row
    beside = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1))))
    of_tile = F.filter("cells", lambda c: ((F.col("d.dx") == 0) | (c.bitwiseAND(255) == 255)) & ((F.col("d.dy") == 0) | (F.shiftright(c, 8) == 255)))
    asked = needed.withColumn("d", beside).withColumn("cells", of_tile).where(F.size("cells") > 0).withColumns({"x": F.col("bx") + F.col("d.dx"), "y": F.col("by") + F.col("d.dy")})
    asked = stored(asked.select("x", "y", "bx", "by", "d", "cells"), "asked")
    # only tiles that are asked for are read on, and none is sent to the driver
    given = terrain.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "metres").join(asked.select("x", "y").distinct(), ["x", "y"], "left_semi")
    tiles = asked.join(given.hint("merge"), ["x", "y"], "left")
    metres = F.coalesce("metres", F.raise_error(F.concat_ws("/", F.lit("no terrain tile"), "x", "y")).cast("array<float>"))

    def corner(c, dx: int, dy: int):
        col, row = c.bitwiseAND(255) + dx - 256 * F.col("d.dx"), F.shiftright(c, 8) + dy - 256 * F.col("d.dy")
        return F.when((col >= 0) & (col < 256) & (row >= 0) & (row < 256), F.get("metres", row * 256 + col)).alias(f"z{dx}{dy}")

    corners = [(dx, dy) for dy in (0, 1) for dx in (0, 1)]
    at = lambda c: F.struct((F.col("bx").cast("long") * 256 + c.bitwiseAND(255)).alias("cx"), (F.col("by").cast("long") * 256 + F.shiftright(c, 8)).alias("cy"), *(corner(c, *d) for d in corners))
    cells = tiles.withColumn("metres", metres).select(F.explode(F.transform("cells", at)).alias("c")).select("c.*")
    cells = cells.groupBy("cx", "cy").agg(*(F.max(f"z{dx}{dy}").cast("double").alias(f"z{dx}{dy}") for dx, dy in corners))
    share = lambda c, far: F.col(c) if far else 1 - F.col(c)
    ele = sum((F.col(f"z{dx}{dy}") * (share("fx", dx) * share("fy", dy)) for dx, dy in corners[1:]), F.col("z00") * (share("fx", 0) * share("fy", 0)))
    return p.join(cells, ["cx", "cy"]).select(*points.columns, ele.alias("ele"))

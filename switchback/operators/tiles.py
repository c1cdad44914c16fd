"""Tiles of the map: which elements and roads belong to each, and the lists that are kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell
from . import build, sets, stretches

# Fixed values.
LEAST_SCORE, ROADS_A_TILE, BITS_KEPT = 15, 250, 300
PAD_DEG, SQUARE_DEG = 0.15, 0.25
PIECE = (3, 4)


def meets(element: Column, box: Column) -> Column:
    """Whether a way has a vertex in a box (s, w, n, e; its edges count), or a node lies in it."""
    inside = lambda p: (p.lat >= box.s) & (p.lat <= box.n) & (p.lon >= box.w) & (p.lon <= box.e)
    return F.when(element.type == "way", F.coalesce(F.exists(element.geometry, inside), F.lit(False))).otherwise(F.coalesce(inside(element), F.lit(False)))


def tile_boxes(tiles: DataFrame, pad: float = 0.0) -> DataFrame:
    """tiles (tile: south_west degrees) with box (s, w, n, e), padded."""
    at = lambda i: F.split_part("tile", F.lit("_"), F.lit(i)).cast("double")
    return tiles.withColumn("box", F.struct((at(1) - pad).alias("s"), (at(2) - pad).alias("w"), (at(1) + 1 + pad).alias("n"), (at(2) + 1 + pad).alias("e")))


def tile_elements(elements: DataFrame, tiles: DataFrame, pad: float = PAD_DEG) -> DataFrame:
    """elements (tile, ord, and ELEMENT's columns) under each tile of ``tiles`` (tile) whose padded box they meet, as area; of files of the nine tiles around it that are in ``tiles``.

    Of equal types and ids, the later in order is taken, at the place of the earlier.
    """
    row = lambda i: F.split_part("tile", F.lit("_"), F.lit(i)).cast("int")
    around = tile_boxes(tiles, pad).withColumn("dy", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))).withColumn("dx", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1)))))
    order = ((F.col("dy") + 1) * 3 + F.col("dx") + 1).cast("long")
    from_ = around.select(
        F.col("tile").alias("area"), "box", order.alias("rank"),
        F.concat_ws("_", (row(1) + F.col("dy")).cast("string"), (row(2) + F.col("dx")).cast("string")).alias("tile")
    )
    found = elements.join(tiles.select("tile"), "tile", "left_semi").join(from_, "tile").where(meets(F.struct("type", "geometry", "lat", "lon"), F.col("box")))
    body = F.struct(*(c for c in elements.columns if c not in ("tile", "ord", "type", "id", "tags")))
    keyed = found.select("area", "type", "id", (F.col("rank") * (1 << 40) + F.col("ord")).alias("ord"), body.alias("body"), F.map_entries("tags").alias("tags"))
    one = sets.latest(keyed, ["area", "type", "id"])
    return one.select(
        "area", (F.dense_rank().over(Window.partitionBy("area").orderBy("ord")) - 1).cast("long").alias("ord"), "type", "id", "body.*",
        F.map_from_entries("tags").alias("tags")
    )


def cells_of(boxes: DataFrame, degrees: float = 0.5) -> DataFrame:
    """boxes (..., box) cut into cells of about so many degrees, from the south-west, row by row: one row each, with cell_box."""
    count = lambda lo, hi: F.ceil((F.col(f"box.{hi}") - F.col(f"box.{lo}")) / degrees - 1e-9)
    b = boxes.withColumns({"rows": count("s", "n"), "cols": count("w", "e")})
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cols").cast("int") - 1)))
    at = lambda lo, hi, k, of: F.col(f"box.{lo}") + (F.col(f"box.{hi}") - F.col(f"box.{lo}")) * k / F.col(of)
    box = F.struct(
        at("s", "n", F.col("i"), "rows").alias("s"), at("w", "e", F.col("j"), "cols").alias("w"), at("s", "n", F.col("i") + 1, "rows").alias("n"),
        at("w", "e", F.col("j") + 1, "cols").alias("e")
    )
    return b.select(*boxes.columns, "i", "j", box.alias("cell_box"))


def filed(elements: DataFrame, size: float = SQUARE_DEG) -> DataFrame:
    """elements under each square (square: row_column) that they touch, once: a way by its vertices, a node by itself."""
    key = lambda p: F.concat_ws("_", cell(p.lat, size).cast("string"), cell(p.lon, size).cast("string"))
    squares = F.when(F.col("type") == "way", F.array_distinct(F.transform("geometry", key))).otherwise(F.array(key(F.struct("lat", "lon"))))
    return elements.withColumn("square", F.explode(squares))


def pieces(squares: DataFrame, size: float = SQUARE_DEG) -> DataFrame:
    """(bi, bj, box, keys): squares (i, j) that are wanted, by blocks of PIECE squares, each block shrunk to the range that is wanted; keys are all squares of that range, row by row."""
    block = {"bi": F.floor(F.col("i") / PIECE[0]), "bj": F.floor(F.col("j") / PIECE[1])}
    r = squares.withColumns(block).groupBy("bi", "bj").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    box = F.struct((F.col("i0") * size).alias("s"), (F.col("j0") * size).alias("w"), ((F.col("i1") + 1) * size).alias("n"), ((F.col("j1") + 1) * size).alias("e"))
    keys = F.flatten(F.transform(F.sequence("i0", "i1"), lambda i: F.transform(F.sequence("j0", "j1"), lambda j: F.concat_ws("_", i.cast("string"), j.cast("string")))))
    return r.select("bi", "bj", box.alias("box"), keys.alias("keys"))


def wanted_squares(boxes: DataFrame, size: float = SQUARE_DEG) -> DataFrame:
    """boxes (..., box) with a row for each square (i, j) of the grid that they reach."""
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(f"box.{lo}"), size), cell(F.col(f"box.{hi}"), size)))
    return boxes.withColumn("i", span("s", "n")).withColumn("j", span("w", "e"))


def middle(coords: Column) -> Column:
    """The vertex in the middle of a line, the later of two."""
    return F.get(coords, F.floor(F.size(coords) / 2).cast("int"))


def owned(roads: DataFrame, box: Column) -> Column:
    """Whether the middle vertex of coords lies in a box, its north and east edges left out."""
    m = middle(F.col("coords"))
    return (m.lat >= box.s) & (m.lat < box.n) & (m.lon >= box.w) & (m.lon < box.e)


def tile_output(roads: DataFrame, least: int = LEAST_SCORE, most: int = ROADS_A_TILE) -> DataFrame:
    """The roads (area, place, score, coords, ...) that each tile keeps: those that it owns, with a score that is worth it, the first so many by place."""
    mine = tile_boxes(roads.withColumn("tile", F.col("area"))).where(owned(roads, F.col("box")) & (F.col("score") >= least)).drop("box")
    w = Window.partitionBy("area").orderBy("place")
    return mine.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def bit_entries(roads: DataFrame, bits: DataFrame) -> DataFrame:
    """What a list of best bits shows of roads (area, pos, id, name, road_text, from, to, len, hairpins, ele_max, pass, coords, score) with a bit (area, id, bit_score, from_m, to_m)."""
    of = lambda f, c: F.round(f(F.transform("coords", lambda p: p[c])), 4)
    box = F.struct(of(F.array_min, "lon").alias("w"), of(F.array_min, "lat").alias("s"), of(F.array_max, "lon").alias("e"), of(F.array_max, "lat").alias("n"))
    return roads.join(bits, ["area", "id"]).select(
        "id", F.col("area").alias("tile"), "pos", "name", "road_text", "from", "to", "len", "hairpins", "ele_max",
        F.col("pass.name").alias("pass_name"), box.alias("bb"), "score", "bit_score", "from_m", "to_m"
    )


def top_bits(entries: DataFrame, most: int = BITS_KEPT) -> DataFrame:
    """The best of bit_entries(): by the bit's score, the road's, then tile and place. One TakeOrdered."""
    return entries.orderBy(F.desc("bit_score"), F.desc("score"), "tile", "pos").limit(most)


def rebuilt_bits(roads: DataFrame, taste: float = 0.5, most: int = BITS_KEPT) -> DataFrame:
    """The list of best bits of roads as tiles hold them (area, pos, id, name, road_text, ref, pass, warn, coords, slices, ...), scored anew."""
    keyed = roads.withColumn("road", F.concat_ws("/", "area", "id"))
    facts = keyed.select("road", F.col("pass.name").alias("pass_name"), F.lit(True).alias("has_ref"), "ref", "name", "road_text", F.col("warn.narrow").alias("narrow"))
    bits = stretches.best_bits(build.road_slices(keyed), facts, taste).select(
        F.split_part("road", F.lit("/"), F.lit(1)).alias("area"), F.split_part("road", F.lit("/"), F.lit(2)).alias("id"), "bit_score", "from_m",
        "to_m"
    )
    return top_bits(bit_entries(roads, bits), most)


def tile_of_ids(index: DataFrame) -> DataFrame:
    """(id, tile) of an index (tile_ord, tile, ids: comma-joined); of an id in two tiles, the later."""
    ids = index.select("tile_ord", "tile", F.explode(F.split("ids", ",")).alias("id"))
    return ids.groupBy("id").agg(F.max(F.struct("tile_ord", "tile")).alias("x")).select("id", "x.tile")

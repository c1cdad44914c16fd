"""The list of roads: searched, filtered, in an order, with bits of tiles that are not loaded; and what is picked from lists."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a list can be ordered by, and what it can show.
SORTS = ("score", "bit", "scenery", "in_bends", "hairpins", "climb", "ele_max", "len")
SHOWS = ("all", "passes", "fav", "unridden", "ridden", "rated")
SHOWN = 300
# Kinds of places in the order they are preferred in, and the ranks of other places and of what is none.
PLACE_KINDS = ("city", "town", "village", "municipality", "suburb", "hamlet")
OTHER_PLACE, NO_PLACE = 8, 9
# Kinds of stops, their icons and labels.
STOPS = {
    "cafe": ("coffee", "Café"), "restaurant": ("fork-knife", "Restaurant"), "fast_food": ("hamburger", "Snack"),
    "ice_cream": ("ice-cream", "Ice cream"), "biergarten": ("beer-stein", "Beer garden"), "pub": ("beer-stein", "Pub"), "fuel": ("gas-pump", "Fuel"),
    "alpine_hut": ("house-line", "Mountain hut")
}


def found_in(query: str, fields: list[Column]) -> Column:
    """Whether any field holds the words, whatever their case; without words, true."""
    q = query.strip().lower()
    holds = [F.coalesce(F.contains(F.lower(f), F.lit(q)), F.lit(False)) for f in fields]
    return functools.reduce(operator.or_, holds, F.lit(False)) if q else F.lit(True)


def shown(roads: DataFrame, show: str, marks: DataFrame | None = None) -> DataFrame:
    """Those of roads (id, pass_name, ...) that a mode shows. marks: id, fav, ridden, rating, at most one row an id, any of them null."""
    if show not in SHOWS:
        raise ValueError(f"show is one of {', '.join(SHOWS)}")
    if show == "all":
        return roads
    if show == "passes":
        return roads.where("pass_name IS NOT NULL")
    picked = marks.where({"fav": "fav", "rated": "rating != 0"}.get(show, "ridden")).select("id")
    return roads.join(picked, "id", "left_anti" if show == "unridden" else "left_semi")


def matching_roads(roads: DataFrame, query: str = "", show: str = "all", marks: DataFrame | None = None) -> DataFrame:
    """roads (id, name, road_text, from, to, pass_name, ...) that a mode shows and in whose texts the words stand."""
    return shown(roads, show, marks).where(found_in(query, [F.col(c) for c in ("name", "road_text", "from", "to", "pass_name")]))


#: Letters of the longest pieces in the index of texts.
GRAM = 3


def _grams(text: Column, sizes: range) -> Column:
    """The distinct pieces of a text in lower case, of so many letters each."""
    low = F.lower(text)
    starts = lambda k: F.when(F.length(low) >= k, F.sequence(F.lit(1), F.length(low) - k + 1)).otherwise(F.array().cast("array<int>"))
    pieces = lambda k: F.transform(starts(k), lambda i: F.substring(low, i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*map(pieces, sizes))))


def text_index(roads: DataFrame, fields: tuple[str, ...] = ("name", "road_text", "from", "to", "pass_name")) -> DataFrame:
    """(gram, id) of roads (id, and texts): every piece of one to three letters of their texts, once a road. To be kept with the tiles, sorted or partitioned by gram; a null text has none."""
    pieces = F.flatten(F.array(*(F.coalesce(_grams(F.col(f), range(1, GRAM + 1)), F.array().cast("array<string>")) for f in fields)))
    return roads.select("id", F.explode(F.array_distinct(pieces)).alias("gram")).select("gram", "id")


def indexed_roads(roads: DataFrame, index: DataFrame, query: str, fields: tuple[str, ...] = ("name", "road_text", "from", "to", "pass_name")) -> DataFrame:
    """The roads (id, and the fields of text_index()) in whose texts the words stand, as found_in() says, from the index: only roads that have all pieces of the words are looked at.

    The words' pieces are literals, so that the scan of the index reads their rows alone; a road is a candidate if it has as many of them as there are. Words of up to three
    letters are pieces themselves, and need no look.
    """
    words = query.strip().lower()
    if not words:
        return roads
    size = min(GRAM, len(words))
    wanted = sorted({words[i : i + size] for i in range(len(words) - size + 1)})
    has = index.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")
    return roads.join(has, "id", "left_semi").where(found_in(query, [F.col(c) for c in fields]))


def bit_stubs(entries: DataFrame, loaded: DataFrame, query: str = "", show: str = "all", marks: DataFrame | None = None) -> DataFrame:
    """Entries of the best bits whose roads (loaded: id) are not loaded, as far as a mode shows them (none by rides) and the words stand in their texts but the pass's."""
    left = entries.join(loaded.select("id"), "id", "left_anti")
    if show in ("ridden", "unridden"):
        return left.limit(0)
    return shown(left, show, marks).where(found_in(query, [F.col(c) for c in ("name", "road_text", "from", "to")]))


def road_list(
    roads: DataFrame, sort: str = "score", query: str = "", show: str = "all", marks: DataFrame | None = None, entries: DataFrame | None = None,
    view: tuple[float, float, float, float] | None = None, most: int = SHOWN
) -> DataFrame:
    """The first roads by a sort key, greatest first, nulls as 0, ties in order (ord); by "bit", those with a bit and then stubs of the others. view: s, w, n, e, which bb has to meet."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}")
    got = matching_roads(roads, query, show, marks).withColumn("stub", F.lit(False))
    if sort == "bit" and entries is not None:
        got = got.where("bit IS NOT NULL").unionByName(bit_stubs(entries, roads, query, show, marks).withColumn("stub", F.lit(True)), allowMissingColumns=True)
    if view is not None:
        got = got.where(boxes_meet(F.col("bb"), *(F.lit(float(x)) for x in view)))
    return got.orderBy(F.desc(F.coalesce(sort, F.lit(0))), "stub", "ord").limit(most)


def boxes_meet(box: Column, s: Column, w: Column, n: Column, e: Column) -> Column:
    """Whether a box (s, w, n, e) and another touch, their edges counting."""
    return (box.s <= n) & (box.n >= s) & (box.w <= e) & (box.e >= w)


def least_drawn(zoom: Column) -> Column:
    """The score from which a map draws roads at a zoom."""
    return F.when(zoom < 7.5, 45).when(zoom < 8.5, 30).otherwise(0)


def glows(score: Column) -> Column:
    return score >= 55


def drawn(roads: DataFrame, zoom: float, selected: str | None = None) -> DataFrame:
    """roads (id, score) on the map at a zoom, without the selected one, with glow."""
    return roads.where((F.col("score") >= least_drawn(F.lit(zoom))) & ~F.col("id").eqNullSafe(F.lit(selected))).withColumn("glow", glows(F.col("score")))


def passes_in(passes: DataFrame, s: float, w: float, n: float, e: float) -> DataFrame:
    """passes (lon, lat) in a box, its edges counting."""
    return passes.where(F.col("lat").between(s, n) & F.col("lon").between(w, e))


def top_feature(features: DataFrame, by: list[str]) -> DataFrame:
    """Of features (ord, score, ...) under each pointer, that of highest score, the first of equals."""
    rest = [c for c in features.columns if c not in (*by, "score", "ord")]
    return features.groupBy(*by).agg(F.max(F.struct("score", (-F.col("ord")).alias("back"), *rest)).alias("x")).select(
        *by, "x.score", (-F.col("x.back")).alias("ord"), *(f"x.{c}" for c in rest)
    )


def best_place(candidates: DataFrame) -> DataFrame:
    """Of the places a search finds (query, ord, osm_key, osm_value, ...), the first of the most preferred kind."""
    rank = F.when(~F.col("osm_key").eqNullSafe(F.lit("place")), NO_PLACE)
    for i, kind in enumerate(PLACE_KINDS):
        rank = rank.when(F.col("osm_value") == kind, i + 1)
    rank = rank.otherwise(OTHER_PLACE)
    w = Window.partitionBy("query").orderBy("rank", "ord")
    return candidates.withColumn("rank", rank).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def stop_kind(tags: Column) -> Column:
    """(icon, kind) of a stop's tags."""
    out = None
    for tag, (icon, label) in STOPS.items():
        hit = F.coalesce(F.try_element_at(tags, F.lit("amenity")) == tag, F.lit(False)) | F.coalesce(F.try_element_at(tags, F.lit("tourism")) == tag, F.lit(False))
        value = F.struct(F.lit(icon).alias("icon"), F.lit(label).alias("kind"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("map-pin").alias("icon"), F.lit("Stop").alias("kind")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): how many rows each table has."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def areas_in_order(areas: DataFrame, newest_first: bool = False) -> DataFrame:
    """Scans by their date, for loading; newest first for a list. Ties by key."""
    return areas.orderBy(F.desc("date") if newest_first else "date", "key")

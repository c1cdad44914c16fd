"""From map elements and terrain to ranked roads: chains, curvy sections, their profile, slices and description.

Every step is a join or a window over one chain or one section. Elements of several areas go through together: area is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.geo import EARTH_M, offset, planar_m
from ..functions.scoring import BALANCED, SLICE_KM, js_round, road_id
from ..sources.elements import classified
from ..storage import stored
from . import sampling, spatial, stretches
from .chains import chained, pairs
from .terrain import elevation

# What a section needs to be a candidate, the slices, and what is looked at around their centres.
LEAST_M, LEAST_CURVY_KM, LEAST_DENSITY = 2500, 1.2, 0.12
PER_SLICE = 20
RING_M, SIDE_M = (800, 1600), (60, 120)
OPEN_BELOW_M, FULL_VIEW = 60, 0.5
DROP_FROM_M, DROP_SPAN_M = 25, 70
VIEWPOINT_M, PASS_M, TOWN_M = 200, 80, 6000


def end_direction(geometry: Column, at_start: bool) -> Column:
    """(dx, dy): the unit vector at an end of a line, from the vertex up to three away to the end, on the plane at the end's latitude; 0 for a line without length."""
    n = F.size(geometry)
    end, other = (F.get(geometry, F.lit(0)), F.get(geometry, F.least(F.lit(3), n - 1))) if at_start else (F.get(geometry, n - 1), F.get(geometry, F.greatest(F.lit(0), n - 4)))
    dx, dy = (end.lon - other.lon) * F.cos(F.radians(end.lat)), end.lat - other.lat
    size = F.hypot(dx, dy)
    return F.struct(F.coalesce(F.try_divide(dx, size), F.lit(0.0)).alias("dx"), F.coalesce(F.try_divide(dy, size), F.lit(0.0)).alias("dy"))


def road_ways(elements: DataFrame) -> DataFrame:
    """(area, way, id, nodes, geometry, key, dx0, dy0, dx1, dy1, facts) of the ways that make roads; way sorts as the elements do (by ord) within an area."""
    t = F.coalesce("tags", F.create_map().cast("map<string, string>"))
    facts = F.struct(
        tags.tag(t, "name").alias("name"), tags.tag(t, "ref").alias("ref"), tags.is_narrow(t).alias("narrow"), tags.is_tunnel(t).alias("tunnel"), tags.off_ground(t).alias("off"), tags.urban(t).alias("urban"),
        F.coalesce(tags.tag(t, "toll") == "yes", F.lit(False)).alias("toll"), tags.closure(t).alias("closed"),
    )
    key = lambda x: F.concat_ws("/", "area", x)
    w = classified(elements).where("kind = 'way'")
    w = w.select(
        "area", key(F.lpad(F.col("ord").cast("string"), 12, "0")).alias("way"), "id",
        F.transform("nodes", lambda n: key(n.cast("string"))).alias("nodes"), "geometry", tags.road_key(t).alias("key"),
        end_direction(F.col("geometry"), True).alias("s"), end_direction(F.col("geometry"), False).alias("e"), facts.alias("facts")
    )
    return w.select(
        "area", "way", "id", "nodes", "geometry", "key", F.col("s.dx").alias("dx0"), F.col("s.dy").alias("dy0"), F.col("e.dx").alias("dx1"),
        F.col("e.dy").alias("dy1"), "facts"
    )


def road_passes(elements: DataFrame, ways: DataFrame) -> DataFrame:
    """(area, pass_id, name, ele, lon, lat) of named passes that are a node of some way (nodes: area/id); pass_id is the element's ord, ele its tag."""
    named = classified(elements).where("kind = 'pass'").withColumn("name", tags.tag(F.col("tags"), "name")).where("name IS NOT NULL")
    p = named.select(
        "area", F.col("ord").alias("pass_id"), "name", tags.tag(F.col("tags"), "ele").alias("ele"), "lon", "lat",
        F.concat_ws("/", "area", F.col("id").cast("string")).alias("node")
    )
    # of all ways' nodes only those of passes go on
    nodes = ways.select(F.explode("nodes").alias("node")).join(p.select("node"), "node", "left_semi").distinct()
    return p.join(nodes, "node", "left_semi").drop("node")


def passes_within(passes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(area, ord, name, ele, lon, lat) of road_passes() within the box (area, s, w, n, e) of their area, edges counting: whole metres or null, places to five decimals."""
    inside = passes.join(boxes, "area").where("lat BETWEEN s AND n AND lon BETWEEN w AND e")
    return inside.select("area", F.col("pass_id").alias("ord"), "name", whole_metres(F.col("ele")).alias("ele"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


def find_areas(elements: DataFrame, terrain: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roads, passes) of areas: find_roads(), and passes_within() their boxes (area, s, w, n, e). An area without roads has no passes either."""
    roads = find_roads(elements, terrain)
    found = stored(classified(elements).where("kind IN ('way', 'pass')"), "elements")
    passes = road_passes(found, road_ways(found))
    return roads, passes_within(passes, boxes).join(roads.select("area").distinct(), "area", "left_semi")


def pass_metres(text: Column) -> Column:
    """The elevation in a tag: its first word, with a comma or a point; null where that does not begin with a number."""
    first = F.replace(F.split_part(text, F.lit(" "), F.lit(1)), F.lit(","), F.lit("."))
    return F.regexp_extract(first, r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1).try_cast("double")


def whole_metres(text: Column) -> Column:
    """The whole number that a tag begins with, or null."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("long")


#: Vertices that one task has of the lines of chains, but for what one road holds.
VERTICES = 500_000


def chain_vertices(chain: DataFrame, ways: DataFrame, parts: int | None = None) -> DataFrame:
    """(road, i, way, lon, lat, x, y, d, cos0): the line of each chain (way, road, pos, reversed), in metres on the plane at its mean latitude; other columns of ways come with their vertices.

    Ways after the first go without their first vertex, which is shared; chains of fewer than three vertices are no roads; a vertex within a centimetre of the one before is left out.
    With parts, whole geometries are dealt to so many tasks by road, and give their vertices there. The mean is taken in order, so the same chain has the same line each time.
    """
    line = F.when(F.col("reversed"), F.reverse("geometry")).otherwise(F.col("geometry"))
    rest = [c for c in ways.columns if c not in ("way", "geometry")]
    g = chain.join(ways, "way").select("road", "pos", "way", *rest, line.alias("line"))
    v = (g.repartition(parts, "road") if parts else g).select("road", "pos", "way", *rest, F.posexplode("line").alias("j", "p")).where("pos = 0 OR j > 0")
    w, o = Window.partitionBy("road").orderBy("i"), Window.partitionBy("road").orderBy("pos", "j")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.select(
        "road", "way", *rest, "p.lon", "p.lat", (F.row_number().over(o) - 1).alias("i"),
        F.avg("p.lat").over(whole).alias("lat0"), F.count("*").over(whole).alias("n")
    ).where("n >= 3")
    v = on_plane(v.withColumn("cos0", F.cos(F.radians("lat0"))))
    gap = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    kept = v.withColumn("gap", gap).where("gap IS NULL OR gap > 0.01").select("road", "i", "way", *rest, "lon", "lat", "x", "y", "cos0")
    return sampling.distances(kept)


def on_plane(points: DataFrame) -> DataFrame:
    """points (lon, lat, cos0) with x and y, metres on the plane at the latitude whose cosine is cos0."""
    return points.withColumns({"x": F.radians("lon") * EARTH_M * F.col("cos0"), "y": F.radians("lat") * EARTH_M})


def owners(vertices: DataFrame, places: DataFrame) -> DataFrame:
    """places (road, d, ...) with way: that of the first vertex (road, d, way) at or behind d, else of the last. One sort of both sides, no join by distance."""
    rest = [c for c in places.columns if c not in ("road", "d")]
    marks = vertices.select("road", "d", F.struct("way").alias("v"), F.lit(None).cast(places.select(F.struct(*rest)).schema[0].dataType).alias("q"))
    both = marks.unionByName(places.select("road", "d", F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.struct(*rest).alias("q")))
    back = Window.partitionBy("road").orderBy(F.desc("d"), F.col("q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("v").isNotNull(), F.struct("d", "v"))).over(Window.partitionBy("road"))
    found = both.withColumns({"at": F.last("v", ignorenulls=True).over(back), "end": last}).where("q IS NOT NULL")
    return found.select("road", "d", "q.*", F.coalesce("at.way", "end.v.way").alias("way"))


def candidates(samples: DataFrame, most: int | None = None, least_m: float = LEAST_M, least_curvy_km: float = LEAST_CURVY_KM, least_density: float = LEAST_DENSITY) -> DataFrame:
    """(road, chain, area, a, b, length, km1..km4, curvy): curvy sections of samples (road, k, cls) that are long, curvy and dense enough, by area the ``most`` curviest.

    km are those of samples before the last; ties go to the earlier chain and section. road is the section's own key from here on.
    """
    # b lies behind all of a section's bends, but where the road ends with one
    km = {f"km{c}": F.count_if((F.col("cls") == c) & (F.col("k") < F.col("end"))) * (sampling.STEP_M / 1000) for c in range(1, 5)}
    s = sampling.sections(samples, counts=km).where("a < b").withColumn("length", (F.col("b") - F.col("a")) * sampling.STEP_M)
    s = s.withColumn("curvy", sum((F.col(f"km{c}") * BALANCED[c - 1] for c in range(1, 5)), F.lit(0.0)))
    s = s.where(
        (F.col("length") >= least_m) & (F.col("curvy") >= least_curvy_km) & (F.col("curvy") / (F.col("length") / 1000) >= least_density)
    ).withColumn("area", F.split_part("road", F.lit("/"), F.lit(1)))
    if most is not None:
        place = F.row_number().over(Window.partitionBy("area").orderBy(F.desc(F.round("curvy", 9)), "road", "a"))
        s = s.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return s.withColumnRenamed("road", "chain").withColumn("road", F.concat_ws(":", "chain", F.lpad(F.col("a").cast("string"), 9, "0")))


def slice_of(k: Column, n: Column) -> Column:
    """The slice of sample k of a section of n samples: the last slice takes what is left over."""
    return F.least(F.greatest(F.lit(1), F.ceil((n - 1) / PER_SLICE)) - 1, F.floor(k / PER_SLICE)).cast("long")


def slice_counts(samples: DataFrame, pins: DataFrame, turns: DataFrame) -> DataFrame:
    """(road, i, c1..c4, u, h, r): samples of each class, built-up samples, hairpins, and crests and dips, by slice.

    samples: road, k, n (samples of the road), cls, urban; its last sample counts for nothing. pins and turns: road, at.
    """
    s = samples.where("k < n - 1").withColumn("i", slice_of(F.col("k"), F.col("n")))
    by = s.groupBy("road", "i").agg(*(F.count_if(F.col("cls") == c).alias(f"c{c}") for c in range(1, 5)), F.count_if("urban").alias("u"))
    sizes = samples.select("road", "n").distinct()

    def counted(points: DataFrame, name: str) -> DataFrame:
        return points.join(sizes, "road").groupBy("road", slice_of(F.col("at"), F.col("n")).alias("i")).agg(F.count("*").alias(name))

    out = by.join(counted(pins, "h"), ["road", "i"], "left").join(counted(turns, "r"), ["road", "i"], "left")
    return out.withColumns({"h": F.coalesce("h", F.lit(0)), "r": F.coalesce("r", F.lit(0))})


def headed(samples: DataFrame, by: tuple[str, ...] = ("road",)) -> DataFrame:
    """Adds hx and hy, the unit direction at the sample in the middle of each slice that has one; null at the others."""
    w = Window.partitionBy(*by).orderBy("k")
    before, after = lambda c: F.coalesce(F.lag(c).over(w), F.col(c)), lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    s = samples.withColumns({"hx": after("x") - before("x"), "hy": after("y") - before("y")})
    middle = (F.col("k") % PER_SLICE == PER_SLICE // 2) & (F.floor(F.col("k") / PER_SLICE) < F.greatest(F.lit(1), F.ceil((F.col("n") - 1) / PER_SLICE)))
    size = F.greatest(F.hypot("hx", "hy"), F.when(F.hypot("hx", "hy") == 0, 1.0).otherwise(0.0))
    return s.withColumns({c: F.when(middle, F.col(c) / size) for c in ("hx", "hy")})


def centres(samples: DataFrame) -> DataFrame:
    """(road, i, k, lon, lat, hx, hy) of the samples that headed() has given a direction."""
    return samples.where("hx IS NOT NULL").select("road", F.floor(F.col("k") / PER_SLICE).alias("i"), "k", "lon", "lat", "hx", "hy")


def surroundings(middles: DataFrame) -> DataFrame:
    """(road, k, what, j, lon, lat): 16 points on two rings around each centre, and four at its sides."""
    ring = [(r * F.cos(F.lit(b) * F.pi() / 4), r * F.sin(F.lit(b) * F.pi() / 4)) for r in RING_M for b in range(8)]
    side = [(-s * m * F.col("hy"), s * m * F.col("hx")) for s in (-1, 1) for m in SIDE_M]
    points = [("ring", j, *p) for j, p in enumerate(ring)] + [("side", j, *p) for j, p in enumerate(side)]
    at = F.explode(F.array(*(F.struct(F.lit(w).alias("what"), F.lit(j).alias("j"), dx.alias("dx"), dy.alias("dy")) for w, j, dx, dy in points)))
    m = middles.withColumn("p", at)
    lon, lat = offset(F.col("lon"), F.col("lat"), F.col("p.dx"), F.col("p.dy"))
    return m.select("road", "k", "p.what", F.col("p.j").alias("j"), lon.alias("lon"), lat.alias("lat"))


def views(middles: DataFrame, profile: DataFrame, around: DataFrame) -> DataFrame:
    """(road, i, v, p), 0 to 9: how open the ground falls away on the rings, and how deep at the sides, from smoothed elevation (road, k, ele) and the points' own (road, k, what, ele)."""
    own = middles.select("road", "i", "k").join(profile.select("road", "k", F.col("ele").alias("own")), ["road", "k"])
    s = around.join(own, ["road", "k"]).groupBy("road", "i", "own").agg(
        F.avg(
            F.when(F.col("what") == "ring", F.when(F.col("ele") <= F.col("own") - OPEN_BELOW_M, 1.0).otherwise(0.0))
        ).alias("open"), F.min(F.when(F.col("what") == "side", F.col("ele"))).alias("low")
    )
    v = F.least(F.lit(9.0), F.col("open") / FULL_VIEW * 9)
    p = F.greatest(F.lit(0.0), F.least(F.lit(9.0), (F.col("own") - F.col("low") - DROP_FROM_M) / DROP_SPAN_M * 9))
    return s.select("road", "i", v.alias("v"), p.alias("p"))


def weighted_mode(parts: DataFrame, value: str) -> DataFrame:
    """(road, value, metres): the value with most metres of parts (road, j, metres, value), the one seen first on ties; null values count for nothing."""
    sums = parts.where(F.col(value).isNotNull()).groupBy("road", value).agg(F.sum("metres").alias("metres"), F.min("j").alias("j"))
    best = sums.groupBy("road").agg(F.max(F.struct(F.round("metres", 6).alias("m"), (-F.col("j")).alias("back"), value, "metres")).alias("b"))
    return best.select("road", f"b.{value}", "b.metres")


def warnings(parts: DataFrame) -> DataFrame:
    """(road, narrow, tunnel, toll, closed) of parts (road, j, metres, length, narrow, tunnel, toll, closed): shares of the length in whole percent, any toll, and the first closure."""
    share = lambda c: js_round(100 * F.sum(F.when(F.col(c), F.col("metres")).otherwise(0.0)) / F.first("length")).cast("long")
    return parts.groupBy("road").agg(
        share("narrow").alias("narrow"), share("tunnel").alias("tunnel"), F.bool_or("toll").alias("toll"),
        F.min(F.when(F.col("closed").isNotNull(), F.struct("j", "closed"))).alias("c")
    ).select("road", "narrow", "tunnel", "toll", "c.closed")


def uphill(roads: DataFrame) -> DataFrame:
    """Roads that fall more than they climb, turned round: coords, towns and slices (town0, town1) reversed, climb and descent swapped; turned says which. Bends and pass stay."""
    down = F.col("descent") > F.col("climb")
    swap = lambda a, b: F.when(down, F.col(b)).otherwise(F.col(a)).alias(a)
    back = lambda c: F.when(down, F.reverse(c)).otherwise(F.col(c)).alias(c)
    new = {
        "coords": back("coords"), "slices": back("slices"), "town0": swap("town0", "town1"), "town1": swap("town1", "town0"),
        "climb": swap("climb", "descent"), "descent": swap("descent", "climb")
    }
    return roads.select(*(new.get(c, F.col(c)) for c in roads.columns), down.alias("turned"))


def road_stats(roads: DataFrame) -> DataFrame:
    """Adds bb (w, s, e, n) of coords, and in_bends, the share of the length (len, metres) that is bends (bends, km)."""
    of = lambda f, c: f(F.transform("coords", lambda p: p[c]))
    box = F.struct(of(F.array_min, "lon").alias("w"), of(F.array_min, "lat").alias("s"), of(F.array_max, "lon").alias("e"), of(F.array_max, "lat").alias("n"))
    return roads.withColumns({"bb": box, "in_bends": F.aggregate("bends", F.lit(0.0), lambda a, b: a + b) / (F.col("len") / 1000)})


def slice_elevation(coords: DataFrame) -> DataFrame:
    """(road, i, ele): elevation at each slice's centre, from coords (road, j, lon, lat, ele, nb): the road's length is that of nb slices. Each segment gives its own centres."""
    w = Window.partitionBy("road").orderBy("j")
    gap = F.coalesce(planar_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    c = coords.withColumn("gap", gap).withColumn("d", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumns(
        {"d0": F.lag("d").over(w), "e0": F.lag("ele").over(w), "unit": F.max("d").over(Window.partitionBy("road")) / F.col("nb"), "last": F.lead("j").over(w).isNull()}
    )
    first, after = F.ceil(F.col("d0") / F.col("unit") - 0.5), F.ceil(F.col("d") / F.col("unit") - 0.5) - 1
    s = c.where("d0 IS NOT NULL AND unit > 0").withColumns(
        {"i0": first, "i1": F.when(F.col("last"), F.col("nb") - 1).otherwise(after)}
    ).where("i1 >= i0").withColumn("i", F.explode(F.sequence("i0", "i1")))
    t = F.coalesce(F.try_divide((F.col("i") + 0.5) * F.col("unit") - F.col("d0"), F.col("d") - F.col("d0")), F.lit(1.0))
    flat = c.where("d0 IS NULL AND unit = 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1))).select(
        "road", F.col("i").cast("long").alias("i"), F.col("ele").cast("double").alias("ele")
    )
    return s.select("road", "i", (F.col("e0") + (F.col("ele") - F.col("e0")) * t).alias("ele")).unionByName(flat)


def road_slices(roads: DataFrame) -> DataFrame:
    """The slices that stretches' functions take, of roads as find_roads() describes them: road, coords (lon, lat, ele) and slices (c1..c4, h, r, v, p, u, x), in order."""
    coords = roads.select("road", F.size("slices").alias("nb"), F.posexplode("coords").alias("j", "p")).select("road", "nb", "j", "p.*")
    s = roads.select("road", F.get("coords", F.lit(0)).lat.alias("lat"), F.posexplode("slices").alias("i", "s")).select("road", "lat", F.col("i").cast("long").alias("i"), "s.*")
    return s.withColumns({"v": F.col("v") / 9, "p": F.col("p") / 9, "u": F.col("u") / PER_SLICE}).join(slice_elevation(coords), ["road", "i"])


def scored(roads: DataFrame, taste: float = 0.5, mix: stretches.Mix = stretches.Mix()) -> DataFrame:
    """stretches.score_roads() of roads as find_roads() describes them."""
    return stretches.score_roads(road_slices(roads), taste, mix)


def ranked(scores: DataFrame) -> DataFrame:
    """(area, section, score, place) of scores (area, section, score, curvy): place from 1 in each area, by score, curvy to nine decimals, and section.

    A road's place is its place among those of its score, behind all of higher ones, so no area is sorted as a whole.
    """
    sums = scores.groupBy("area", "score").agg(F.count("*").alias("n"))
    higher = F.coalesce(F.sum("n").over(Window.partitionBy("area").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = F.row_number().over(Window.partitionBy("area", "score").orderBy(F.desc(F.round("curvy", 9)), "section"))
    places = scores.withColumn("equal", equal).join(sums.select("area", "score", higher.alias("higher")), ["area", "score"])
    return places.select("area", "section", "score", (F.col("higher") + F.col("equal")).alias("place"))


def find_roads(elements: DataFrame, terrain: DataFrame) -> DataFrame:
    """The roads of each area of map elements, described, scored and ranked (place from 1): all sections that are long, curvy and dense enough.

    elements: area, ord and the columns of sources.elements.ELEMENT, distinct by type and id; terrain: x, y, metres, tiles as read_terrain() gives them. A tile
    that a road needs and terrain lacks is an error. Elevation is rounded to whole metres in coords, slices to whole digits. Elements without roads give no rows.
    """
    found = stored(classified(elements).where("kind IS NOT NULL"), "elements")
    others = stored(found.where("kind != 'way'"), "others")
    ways = road_ways(found)
    passes = stored(road_passes(others, ways), "passes")
    chain = stored(chained(ways.select("way"), stored(pairs(ways.select("way", "nodes", "key", "dx0", "dy0", "dx1", "dy1")), "links")), "chains")
    # candidates come of all chains in one stage, which writes nothing else; vertices and samples are kept of their chains only
    size = ways.agg(F.coalesce(F.sum(F.size("geometry")), F.lit(0))).first()[0]
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // VERTICES))
    lines = ways.select("way", "geometry", "facts.off", "facts.urban")
    cand = stored(candidates(sampling.bend_classes(sampling.resample(chain_vertices(chain, lines.select("way", "geometry"), parts)))), "candidates")
    picked = stored(chain.join(cand.select(F.col("chain").alias("road")), "road", "left_semi"), "picked")
    vertices = on_plane(stored(chain_vertices(picked, lines, parts).drop("x", "y"), "vertices"))
    # all that takes a window over a section's samples is found where they are made: they lie by chain, and a section is part of one
    samples = sampling.bend_classes(sampling.resample(vertices, carry=("cos0", "off", "urban"))).join(cand.select(F.col("chain").alias("road"), F.col("road").alias("section"), "a", "b"), "road")
    samples = samples.where("k BETWEEN a AND b").withColumns({"k": F.col("k") - F.col("a"), "n": F.col("b") - F.col("a") + 1})
    samples = headed(sampling.hairpin_steps(sampling.turning(samples, by=("road", "section")), by=("road", "section")), ("road", "section"))
    samples = stored(samples.drop("owner", "a", "b", "turned"), "samples")
    s = samples.drop("road").withColumnRenamed("section", "road").withColumns({"lon": F.degrees(F.col("x") / (EARTH_M * F.col("cos0"))), "lat": F.degrees(F.col("y") / EARTH_M)})

    middles = stored(centres(s), "centres")
    pass_points = passes.select(F.col("area").alias("road"), F.col("pass_id").alias("k"), F.lit("pass").alias("what"), "lon", "lat")
    points = surroundings(middles).drop("j").unionByName(pass_points).withColumn("off", F.lit(None).cast("boolean"))
    points = s.select("road", "k", F.lit("road").alias("what"), "lon", "lat", "off").unionByName(points)
    heights = stored(elevation(points, terrain).drop("lon", "lat"), "heights")
    raw = heights.where("what = 'road'").select("road", "k", "off", "ele")
    # dealt once for all that goes through a road's profile
    profile = stored(sampling.smooth_elevation(sampling.filled_ground(raw)), "profile").repartition("road")
    climb = sampling.climbs(profile)
    pins = stored(sampling.taken_hairpins(s), "hairpins")
    counts = slice_counts(s, pins, sampling.crests_and_dips(profile))
    place_tags = others.where("kind = 'place'").select(
        "area", F.col("ord").alias("place_id"), tags.tag(F.col("tags"), "name").alias("name"), tags.tag(F.col("tags"), "place").alias("kind"),
        F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")
    )
    at_centres = middles.withColumns({"point_id": F.struct("road", "i"), "area": F.split_part("road", F.lit("/"), F.lit(1))})
    in_place = spatial.near_places(at_centres, place_tags).select("point_id.*", F.lit(True).alias("in_place"))
    lookouts = others.where("kind = 'viewpoint'").select("area", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    seen = spatial.near_points(at_centres, lookouts, VIEWPOINT_M).select("point_id.*", F.lit(1).alias("x"))
    table = counts.join(views(middles, profile.where(F.col("k") % PER_SLICE == PER_SLICE // 2), heights.where("what IN ('ring', 'side')")), ["road", "i"], "left").join(in_place, ["road", "i"], "left").join(seen, ["road", "i"], "left")
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(35), js_round(c))).cast("int")
    fields = {f"c{c}": F.col(f"c{c}") for c in range(1, 5)} | {
        "h": F.col("h"), "r": F.col("r"), "v": F.coalesce("v", F.lit(0.0)), "p": F.coalesce("p", F.lit(0.0)),
        "u": F.when(F.col("in_place"), PER_SLICE).otherwise(F.col("u")), "x": F.coalesce("x", F.lit(0))
    }
    slices = table.groupBy("road").agg(
        F.array_sort(F.collect_list(F.struct("i", *(whole(v).alias(n) for n, v in fields.items())))).alias("l")
    ).select("road", F.transform("l", lambda e: e.dropFields("i")).alias("slices"))

    outline = stored(_outline(cand, vertices), "outline")
    parts = stored(_parts(outline, cand, vertices, ways), "parts")
    name, ref = weighted_mode(parts, "name"), weighted_mode(parts, "ref")
    coords = _with_elevation(outline, cand, profile)
    ends = stored(outline.groupBy("road").agg(F.min(F.struct("d", "lon", "lat")).alias("p0"), F.max(F.struct("d", "lon", "lat")).alias("p1")), "ends")
    at_ends = ends.select(
        F.col("road"), F.explode(F.array(*(F.struct(F.lit(e).alias("end"), f"p{e}.lon", f"p{e}.lat") for e in (0, 1)))).alias("p")
    ).select("road", F.split_part("road", F.lit("/"), F.lit(1)).alias("area"), "p.*", F.struct("road", "p.end").alias("point_id"))
    near = spatial.nearest_place(at_ends, place_tags, TOWN_M).join(place_tags.select("place_id", "area", "name"), ["place_id", "area"]).select("point_id.*", "name")
    towns = near.groupBy("road").agg(F.max(F.when(F.col("end") == 0, F.col("name"))).alias("town0"), F.max(F.when(F.col("end") == 1, F.col("name"))).alias("town1"))
    tops = passes.join(heights.where("what = 'pass'").select(F.col("road").alias("area"), F.col("k").alias("pass_id"), F.col("ele").alias("ground")), ["area", "pass_id"]).select(
        "area", "pass_id", F.col("name").alias("pass_name"), F.coalesce(pass_metres(F.col("ele")), "ground").alias("ele"),
        F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")
    )
    corners = outline.select("road", F.split_part("road", F.lit("/"), F.lit(1)).alias("area"), "lon", "lat")
    top = spatial.highest_pass(corners, tops, PASS_M).withColumn("area", F.split_part("road", F.lit("/"), F.lit(1))).join(tops.drop("ele"), ["area", "pass_id"]).select(
        "road",
        F.struct(F.col("pass_name").alias("name"), F.col("ele").cast("long").alias("ele"), F.round("p_lon", 5).alias("lon"), F.round("p_lat", 5).alias("lat")).alias("pass")
    )

    of = lambda f: js_round(f(F.transform("l", lambda e: e.v))).cast("long")
    heads = sampling.listed(profile, F.col("ele")).select("road", of(F.array_min).alias("ele_min"), of(F.array_max).alias("ele_max"))
    r = cand.join(slices, "road").join(coords, "road").join(climb, "road").join(heads, "road").join(pins.groupBy("road").agg(F.count("*").alias("hairpins")), "road", "left")
    r = r.join(name.withColumnRenamed("metres", "name_m"), "road", "left").join(ref.drop("metres"), "road", "left").join(warnings(parts), "road").join(towns, "road", "left").join(top, "road", "left")
    r = r.withColumns({"climb": F.col("up"), "descent": F.col("down"), "share": F.coalesce(F.col("name_m") / F.col("length"), F.lit(0.0))})
    r = uphill(r).withColumn("title", tags.title(F.col("pass.name"), F.col("name"), F.col("share"), F.col("ref")))
    end = lambda at, c: F.element_at("coords", at)[c]
    described = stored(r.select(
        "area", F.concat_ws(
            "/", "area", road_id(end(1, "lon"), end(1, "lat"), end(-1, "lon"), end(-1, "lat"))
        ).alias("road"), road_id(end(1, "lon"), end(1, "lat"), end(-1, "lon"), end(-1, "lat")).alias("id"), F.col("road").alias("section"), "curvy",
        F.col("title").alias("name"), F.nullif(
            tags.subtitle(F.col("title"), F.col("name"), F.col("share"), F.col("ref")), F.lit("")
        ).alias("road_text"), "ref", F.col("town0").alias("from"), F.when(~F.col("town1").eqNullSafe(F.col("town0")), F.col("town1")).alias("to"),
        js_round(F.col("length")).cast("long").alias("len"), F.array(*(F.round(f"km{c}", 2) for c in range(1, 5))).alias("bends"), F.coalesce("hairpins", F.lit(0)).alias("hairpins"), js_round(F.col("climb")).cast("long").alias("climb"), js_round(F.col("descent")).cast("long").alias("descent"),
        "ele_min", "ele_max", F.round(F.col("grade") * 100, 1).alias("max_grade"), "pass", F.struct("narrow", "tunnel", "toll", "closed").alias("warn"), "coords", "slices",
    ), "roads")
    scores = scored(described.drop("road").withColumnRenamed("section", "road")).select(F.col("road").alias("section"), "score")
    places = ranked(described.select("area", "section", "curvy").join(scores, "section"))
    return described.join(places.drop("area"), "section").drop("section", "road")


def _outline(cand: DataFrame, vertices: DataFrame) -> DataFrame:
    """(road, chain, d, lon, lat): the ends of each section and the chain's vertices between them, simplified to two metres."""
    c = cand.select("chain", "road", (F.col("a") * sampling.STEP_M).alias("d0"), (F.col("b") * sampling.STEP_M).alias("d1"))
    w = Window.partitionBy("road").orderBy("i")
    seg = sampling.distances(vertices.drop("d")).withColumns({"dp": F.lag("d").over(w), "lonp": F.lag("lon").over(w), "latp": F.lag("lat").over(w)}).withColumnRenamed("road", "chain")
    met = seg.select("chain", "d", "lon", "lat", "cos0", "dp", "lonp", "latp").join(c, "chain")
    at = lambda c, end: (F.col(f"{c}p") + (F.col(c) - F.col(f"{c}p")) * (F.col(end) - F.col("dp")) / (F.col("d") - F.col("dp"))).alias(c)
    own = F.when(F.expr("d > d0 AND d < d1"), F.struct("d", "lon", "lat"))
    ends = [F.when(F.expr(f"dp IS NOT NULL AND dp <= {e} AND {e} < d"), F.struct(F.col(e).alias("d"), at("lon", e), at("lat", e))) for e in ("d0", "d1")]
    out = met.select("chain", "road", "cos0", F.explode(F.array_compact(F.array(own, *ends))).alias("p")).select("road", "chain", "p.*", "cos0")
    # sections are parts of chains, by which the rows lie already
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("chain", "road").orderBy("d")) - 1)
    out = stored(out, "outline")
    kept = sampling.simplified(on_plane(out)).withColumnRenamed("at", "k")
    return out.join(kept, ["road", "k"], "left_semi").select("road", "chain", "d", "lon", "lat")


def _parts(outline: DataFrame, cand: DataFrame, vertices: DataFrame, ways: DataFrame) -> DataFrame:
    """(road, j, metres, length, facts.*) of the lines between the outline's points, by the way at the middle of each."""
    w = Window.partitionBy("road").orderBy("d")
    p = outline.withColumns({"to": F.lead("d").over(w), "j": F.row_number().over(w)}).where("to IS NOT NULL")
    mid = p.select(F.col("chain").alias("road"), ((F.col("d") + F.col("to")) / 2).alias("d"), F.col("road").alias("section"), "j", (F.col("to") - F.col("d")).alias("metres"))
    got = owners(vertices, mid).join(ways.select("way", "facts.*"), "way")
    return got.drop("road", "d", "way").withColumnRenamed("section", "road").join(cand.select("road", "length"), "road")


def _with_elevation(outline: DataFrame, cand: DataFrame, profile: DataFrame) -> DataFrame:
    """(road, coords): outline in order, to five decimals, with ele in whole metres, between the smoothed samples around each point."""
    lines = outline.groupBy("road").agg(F.array_sort(F.collect_list(F.struct("d", "lon", "lat"))).alias("line"))
    met = lines.join(sampling.listed(profile, F.col("ele")), "road").join(cand.select("road", "a", "b"), "road")
    t = lambda p: p.d / sampling.STEP_M - F.col("a")
    k = lambda p: F.least(F.floor(t(p)), F.col("b") - F.col("a") - 1).cast("int")

    def point(p: Column) -> Column:
        e0 = F.get("l", k(p)).v
        e1 = F.coalesce(F.get("l", k(p) + 1).v, e0)
        return F.struct(F.round(p.lon, 5).alias("lon"), F.round(p.lat, 5).alias("lat"), js_round(e0 + (e1 - e0) * (t(p) - k(p))).cast("double").alias("ele"))

    return met.select("road", F.transform("line", point).alias("coords"))

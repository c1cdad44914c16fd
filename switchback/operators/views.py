"""A road as it is looked at: its smoothed line in a direction, and lookups along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RIDE_DEG_M, haversine_m
from ..functions.scoring import js_round
from ..storage import stored

# Metres a degree of latitude and of longitude at the equator on the smoothed line's plane, and grades between colours.
LAT_M, LON_M = 110540.0, RIDE_DEG_M
GRADES = (0.04, 0.07, 0.1)


def interpolate(lines: DataFrame, places: DataFrame, values: list[str]) -> DataFrame:
    """places (road, x, ...) with values between the points (road, x, values) of their road around x, held at the ends.

    Points and places are sorted together once; of equal x the last point counts. A road without points gives null.
    """
    rest = [c for c in places.columns if c not in ("road", "x")]
    p = lines.select("road", "x", F.struct("x", *values).alias("p"))
    q = places.select("road", "x", F.struct(*rest).alias("q")) if rest else places.select("road", "x", F.struct(F.lit(1).alias("one")).alias("q"))
    both = p.unionByName(q, allowMissingColumns=True)
    seen = Window.partitionBy("road").orderBy("x", F.col("q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("road").orderBy(F.desc("x"), F.col("q").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"a": F.last("p", ignorenulls=True).over(seen), "b": F.last("p", ignorenulls=True).over(ahead)}).where("q IS NOT NULL")
    t = F.coalesce(F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x")), F.lit(0.0))
    at = [F.coalesce(F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * t, F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v) for v in values]
    return both.select("road", "x", *(f"q.{c}" for c in rest), *at)


def directed(roads: DataFrame, reversed_: Column) -> DataFrame:
    """roads (coords, from, to, climb, descent) as seen in a direction: reversed swaps towns, climb and descent, and turns coords round."""
    turn = lambda a, b: F.when(reversed_, F.col(b)).otherwise(F.col(a)).alias(a)
    new = {
        "from": turn("from", "to"), "to": turn("to", "from"), "climb": turn("climb", "descent"), "descent": turn("descent", "climb"),
        "coords": F.when(reversed_, F.reverse("coords")).otherwise(F.col("coords")).alias("coords")
    }
    return roads.select(*(new.get(c, F.col(c)) for c in roads.columns))


def smooth_path(coords: DataFrame, spacing: float = 2.0) -> DataFrame:
    """(road, k, lon, lat, ele): a centripetal Catmull-Rom line through coords (road, j, lon, lat, ele), a point about every ``spacing`` metres, and the last vertex.

    Each piece needs its two vertices and their neighbours, at the ends mirrored, so pieces are rows of one window and their points are in closed form.
    """
    w = Window.partitionBy("road").orderBy("j")
    c = coords.withColumn("kx", LON_M * F.cos(F.radians(F.first("lat").over(w))))
    c = c.select("road", "j", "ele", "lon", "lat", "kx", (F.col("lon") * F.col("kx")).alias("x1"), (F.col("lat") * LAT_M).alias("y1"))
    c = c.withColumns(
        {f"{a}{n}": (F.lag if k < 0 else F.lead)(f"{a}1", abs(k)).over(w) for a in "xy" for n, k in (("0", -1), ("2", 1), ("3", 2))} | {"ele2": F.lead("ele").over(w)}
    )
    last = c.where("x2 IS NULL").select("road", F.col("j"), F.lit(0).alias("s"), "lon", "lat", F.col("ele").cast("double").alias("ele"))
    c = c.where("x2 IS NOT NULL").withColumns(
        {f"{a}0": F.coalesce(f"{a}0", 2 * F.col(f"{a}1") - F.col(f"{a}2")) for a in "xy"} | {f"{a}3": F.coalesce(f"{a}3", 2 * F.col(f"{a}2") - F.col(f"{a}1")) for a in "xy"}
    )
    gap = lambda m, n: F.greatest(F.hypot(F.col(f"x{n}") - F.col(f"x{m}"), F.col(f"y{n}") - F.col(f"y{m}")), F.lit(1e-6))
    c = c.withColumns(
        {"t1": F.sqrt(gap(0, 1)), "steps": F.greatest(F.lit(1), F.ceil(gap(1, 2) / spacing)).cast("int")}
    ).withColumn("t2", F.col("t1") + F.sqrt(gap(1, 2))).withColumn("t3", F.col("t2") + F.sqrt(gap(2, 3)))
    c = c.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("u", F.col("s") / F.col("steps")).withColumn(
        "t", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("u")
    )
    zero = F.lit(0.0)

    def between(a: Column, b: Column, lo: Column, hi: Column) -> Column:
        return a + (b - a) * (F.col("t") - lo) / (hi - lo)

    def curve(axis: str) -> Column:
        p, (t1, t2, t3) = [F.col(f"{axis}{n}") for n in range(4)], (F.col(f"t{n}") for n in (1, 2, 3))
        first, middle, third = between(p[0], p[1], zero, t1), between(p[1], p[2], t1, t2), between(p[2], p[3], t2, t3)
        return between(between(first, middle, zero, t2), between(middle, third, t1, t3), t1, t2)

    line = c.select(
        "road", "j", "s", (curve("x") / F.col("kx")).alias("lon"), (curve("y") / LAT_M).alias("lat"),
        (F.col("ele") + (F.col("ele2") - F.col("ele")) * F.col("u")).alias("ele")
    )
    return line.unionByName(last).withColumn("k", F.row_number().over(Window.partitionBy("road").orderBy("j", "s")) - 1).drop("j", "s")


def along(line: DataFrame) -> DataFrame:
    """line (road, k, lon, lat, ele) with x, the metres from its start by great circles, and total."""
    w = Window.partitionBy("road").orderBy("k")
    gap = F.coalesce(haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    x = line.withColumn("gap", gap).withColumn("x", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    return x.withColumn("total", F.max("x").over(Window.partitionBy("road")))


def grades(line: DataFrame, places: DataFrame, reach: float = 150.0) -> DataFrame:
    """places (road, x) with grade: the rise from reach before to reach behind, held at the ends, over the metres between. line: along()."""
    total = line.groupBy("road").agg(F.max("x").alias("total"))
    p = places.join(total, "road").withColumn("e", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumnRenamed("x", "d")
    p = p.withColumn("x", F.greatest(F.lit(0.0), F.least("total", F.col("d") + F.col("e") * reach)))
    got = interpolate(line, p, ["ele"]).groupBy("road", "d").agg(
        *(F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{c}{n}") for e, n in ((-1, "0"), (1, "1")) for c in ("x", "ele"))
    )
    return got.select("road", F.col("d").alias("x"), F.coalesce(F.try_divide(F.col("ele1") - F.col("ele0"), F.col("x1") - F.col("x0")), F.lit(0.0)).alias("grade"))


def profile_bands(line: DataFrame) -> DataFrame:
    """(road, band, from_m, to_m, grade, colour): about sixty bands of 200 m to 1 km, each with the grade over itself and its neighbours and the colour (1 to 4) of that."""
    total = line.groupBy("road").agg(F.max("x").alias("total"))
    size = F.greatest(F.lit(200.0), F.least(F.lit(1000.0), F.col("total") / 60))
    b = total.withColumn("n", F.greatest(F.lit(2), js_round(F.col("total") / size)).cast("int")).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    b = b.select(
        "road", "band", (F.col("total") * F.col("band") / F.col("n")).alias("from_m"),
        (F.col("total") * (F.col("band") + 1) / F.col("n")).alias("to_m"), "total", (F.col("total") / F.col("n")).alias("w")
    )
    ends = b.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "x", F.when(F.col("e") == 0, F.greatest(F.lit(0.0), F.col("from_m") - F.col("w"))).otherwise(F.least("total", F.col("to_m") + F.col("w")))
    )
    got = interpolate(line, ends, ["ele"]).groupBy("road", "band", "from_m", "to_m").agg(
        *(F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{c}{e}") for e in (0, 1) for c in ("x", "ele"))
    )
    grade = F.coalesce(F.try_divide(F.col("ele1") - F.col("ele0"), F.col("x1") - F.col("x0")), F.lit(0.0))
    return got.select("road", "band", "from_m", "to_m", grade.alias("grade"), grade_colour(grade).alias("colour"))


def grade_colour(grade: Column) -> Column:
    return 1 + sum((F.when(F.abs(grade) >= g, 1).otherwise(0) for g in GRADES), F.lit(0))


def profile_points(line: DataFrame, n: int = 120) -> DataFrame:
    """(road, i, x, ele): n points from end to end."""
    total = line.groupBy("road").agg(F.max("x").alias("total")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return interpolate(line, total.select("road", "i", (F.col("total") * F.col("i") / (n - 1)).alias("x")), ["ele"])


#: Vertices of a cell that a point may meet one by one, and how often a road's box may be cut in four along either axis for that.
CROWD, CUTS = 16, 8


def nearest_metres(line: DataFrame, points: DataFrame, every: int = 4) -> DataFrame:
    """points (road, point_id, p_lon, p_lat) with x: the metres along of the nearest of every fourth vertex, by squared degrees, the first of equals.

    However a road winds, its box is cut in four along either axis until the fullest cell holds at most CROWD vertices. A point meets the boxes of what lies in cells, and keeps those
    that may be nearer than the farthest corner of the best one; only in the last of them does it meet vertices. Of points, and of vertices, at one spot one is looked at.
    """
    some, each = line.where(F.col("k") % every == 0), ["road", "p_lon", "p_lat"]
    finite = lambda *names: F.coalesce(F.expr(" AND ".join(f"{c} BETWEEN -1e6D AND 1e6D" for c in names)), F.lit(False))
    spots = some.where(finite("lon", "lat")).groupBy("road", "lon", "lat").agg(F.min(F.struct("k", "x")).alias("v"))
    ends = {f"{c}_{n}": (f, c) for c in ("lon", "lat") for f, n in ((F.min, "lo"), (F.max, "hi"))}
    whole = spots.groupBy("road").agg(*(f(c).alias(n) for n, (f, c) in ends.items()))
    part = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")), F.lit(0.0))
    fine = [F.least(F.lit(4**CUTS - 1), F.floor(part(c) * 4**CUTS)).cast("long").alias(f"fine_{x}") for x, c in (("x", "lon"), ("y", "lat"))]
    placed = stored(spots.join(whole, "road").select("road", "lon", "lat", "v", *fine), "spots")
    roads = placed.select("road").distinct()
    reach = lambda c: F.greatest(F.abs(F.col(f"p_{c}") - F.col(f"{c}_lo")), F.abs(F.col(f"p_{c}") - F.col(f"{c}_hi")))
    off = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}_lo") - F.col(f"p_{c}"), F.col(f"p_{c}") - F.col(f"{c}_hi"))
    farthest, least = (F.pow(f("lon"), 2) + F.pow(f("lat"), 2) for f in (reach, off))
    asked = points.where(finite("p_lon", "p_lat")).select(*each).distinct().withColumns({"cell_x": F.lit(0).cast("long"), "cell_y": F.lit(0).cast("long")})
    # small tables, but long work: dealt by point, to tasks that gather its cells without another exchange
    dealt = lambda df: df.repartition(int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")), *each)
    for cuts in range(1, CUTS + 1):
        shift = 2 * (CUTS - cuts)
        at = {f"{n}_{x}": F.shiftright(f"fine_{x}", k) for n, k in (("cell", shift + 2), ("in", shift)) for x in "xy"}
        boxes = stored(placed.withColumns(at).groupBy("road", *at).agg(*(f(c).alias(n) for n, (f, c) in ends.items()), F.count("*").alias("crowd")), "boxes")
        near = dealt(asked).join(boxes, ["road", "cell_x", "cell_y"]).select(*each, "in_x", "in_y", least.alias("least"), farthest.alias("farthest"))
        best = near.groupBy(*each).agg(F.min("farthest").alias("best"), F.collect_list(F.struct("in_x", "in_y", "least")).alias("cells"))
        left = best.select(*each, "best", F.explode("cells").alias("at")).where(F.col("at.least") <= F.col("best") * (1 + 1e-9))
        asked = stored(left.select(*each, F.col("at.in_x").alias("cell_x"), F.col("at.in_y").alias("cell_y")), "near")
        if boxes.agg(F.coalesce(F.max("crowd"), F.lit(0))).first()[0] <= CROWD:
            break
    q = F.pow(F.col("lon") - F.col("p_lon"), 2) + F.pow(F.col("lat") - F.col("p_lat"), 2)
    opened = placed.select("road", "lon", "lat", "v", *(F.shiftright(f"fine_{x}", shift).alias(f"cell_{x}") for x in "xy"))
    found = dealt(asked).join(opened, ["road", "cell_x", "cell_y"]).groupBy(*each).agg(F.min(F.struct(q.isNull().alias("none"), q.alias("q"), "v.k", "v.x")).alias("b"))
    # points that are nowhere, and those of roads that are, are as near to all vertices as numbers tell
    lost = points.where(~finite("p_lon", "p_lat")).unionByName(points.where(finite("p_lon", "p_lat")).join(roads, "road", "left_anti").select(*points.columns))
    nowhere = lost.join(some, "road").select("road", "point_id", F.struct(q.isNull().alias("none"), q.alias("q"), "k", "x").alias("b"))
    both = points.join(found, each).select("road", "point_id", "b").unionByName(nowhere)
    return both.groupBy("road", "point_id").agg(F.min("b").alias("b")).select("road", "point_id", "b.x")


def stops_by_km(line: DataFrame, stops: DataFrame, most: int = 12) -> DataFrame:
    """(road, point_id, x, place): stops of each road in the order they come along it, the first so many."""
    w = Window.partitionBy("road").orderBy("x", "point_id")
    return nearest_metres(line, stops).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def stops_near(coords: DataFrame, pois: DataFrame, most_m: float = 200.0, samples: int = 120, most: int = 80) -> DataFrame:
    """(road, point_id): places to stop (point_id, p_lon, p_lat) within most_m of about ``samples`` vertices of each road's coords (road, j, n, lon, lat), its last always among them; the first ``most`` a road."""
    from .spatial import grid_join

    step = F.greatest(F.lit(1), F.ceil(F.col("n") / samples))
    some = coords.where((F.col("j") % step == 0) | (F.col("j") == F.col("n") - 1))
    near = grid_join(some, pois, 0.02, most_m).where(F.col("metres") <= most_m).select("road", "point_id").distinct()
    w = Window.partitionBy("road").orderBy("point_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def highest_point(coords: Column) -> Column:
    """The vertex of most elevation, the first of equals, of an array of (lon, lat, ele)."""
    return F.reduce(coords, F.get(coords, F.lit(0)), lambda a, b: F.when(b.ele > a.ele, b).otherwise(a))


def to_view(metres: Column, length: Column, total: Column, reversed_: Column) -> Column:
    """Metres along the stored road as metres along the line in view."""
    x = metres * total / F.coalesce(F.nullif(length, F.lit(0.0)), total)
    return F.greatest(F.lit(0.0), F.least(total, F.when(reversed_, total - x).otherwise(x)))


def span_in_view(a: Column, b: Column, length: Column, total: Column, reversed_: Column) -> Column:
    """(from_m, to_m) of a stretch of the stored road, in the order of the view."""
    p, q = to_view(a, length, total, reversed_), to_view(b, length, total, reversed_)
    return F.struct(F.least(p, q).alias("from_m"), F.greatest(p, q).alias("to_m"))


def classed(line: DataFrame, samples: DataFrame, step: float = 10.0) -> DataFrame:
    """line (road, k, x, ...) with cls, that of the sample (road, i from 0, cls; a step apart) nearest along it, the last beyond the end."""
    last = samples.groupBy("road").agg(F.max("i").alias("last"))
    at = line.join(last, "road").withColumn("i", F.greatest(F.lit(0), F.least("last", js_round(F.col("x") / step))).cast("long"))
    return at.join(samples.select("road", F.col("i").cast("long").alias("i"), "cls"), ["road", "i"]).drop("i", "last")


def bend_lines(line: DataFrame) -> DataFrame:
    """(road, run, cls, points array<struct<lon, lat>>): a line (road, k, lon, lat, cls) cut where its class changes; the vertex of a change ends one run and begins the next.

    A step between vertices has the class of the one that it leaves, so a last vertex of another class makes no run, and a line of one vertex has none.
    """
    w = Window.partitionBy("road").orderBy("k")
    s = line.withColumns({"to": F.lead(F.struct("k", "lon", "lat")).over(w)}).where("to IS NOT NULL")
    s = s.withColumn("run", F.sum(F.when(F.col("cls") == F.lag("cls").over(w), 0).otherwise(1)).over(w))
    runs = s.groupBy("road", "run").agg(F.first("cls").alias("cls"), F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"), F.max("to").alias("end"))
    return runs.select("road", "run", "cls", F.transform(F.concat("p", F.array("end")), lambda v: F.struct(v.lon.alias("lon"), v.lat.alias("lat"))).alias("points"))


def stretch_lines(line: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (road, from_m, to_m; none of a road twice) with points array<struct<lon, lat>>: the line (road, x, lon, lat) from one to the other, both between its vertices, with the vertices that lie within."""
    ends = parts.select("road", "from_m", "to_m", F.explode(F.array("from_m", "to_m")).alias("x")).withColumn("x", F.col("x").cast("double"))
    cut = interpolate(line, ends, ["lon", "lat"])
    within = line.join(parts, "road").where("x > from_m AND x < to_m").select("road", "from_m", "to_m", "x", "lon", "lat")
    place = F.struct("x", (F.col("x") != F.col("from_m")).alias("later"), "lon", "lat")
    both = cut.withColumn("p", place).unionByName(within.withColumn("p", place)).groupBy("road", "from_m", "to_m").agg(F.array_sort(F.collect_list("p")).alias("l"))
    return both.select("road", "from_m", "to_m", F.transform("l", lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"))).alias("points"))

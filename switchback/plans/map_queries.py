"""Queries of the build, the tiles, the list and the views, each with SQL written another way than the operator. All rows of the tables take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, texts
from ..operators import build, listing, sampling, sets, spatial, tiles, views
from ..operators.terrain import elevation
from ..sources import regions, tracks
from ..sources.elements import requested, tile_index
from ..storage import shared_dir, stored
from ..streaming import tiles as followed
from .adapters import AREAS, PATH, POINTS, SCAN_ROADS, SCANS, WAYS, view
from .queries import CLASSES_SQL, DIST_SQL, ORACLE_SQL, QUERIES, query, rounded, span

__all__ = ["ORACLE_SQL", "QUERIES"]

EARTH = "6371008.8::DOUBLE"


def _nodes(df: DataFrame, tags: dict) -> DataFrame:
    """Elements of nodes (ord, id, lat, lon) with tags from columns; null values are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(v) if isinstance(v, str) else v).alias("v")) for k, v in tags.items()))
    return df.select(
        F.lit("a").alias("area"), "ord", F.lit("node").alias("type"), "id", F.lit(None).cast("array<long>").alias("nodes"),
        F.lit(None).cast("array<struct<lat: double, lon: double>>").alias("geometry"), "lat", "lon",
        F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull())).alias("tags")
    )


# ---------------------------------------------------------------- the build

PASS_TEXT = "CASE p_size % 6 WHEN 0 THEN '1 234' WHEN 1 THEN '1234,5 m' WHEN 2 THEN 'high' WHEN 3 THEN p_partkey || '.7 m' WHEN 4 THEN '' END"


@query(
    f"""WITH w AS ({WAYS}), n AS (SELECT n0 AS node FROM w UNION SELECT n1 FROM w), p AS (SELECT *, {PASS_TEXT} AS ele FROM part)
SELECT p_partkey AS pass_id, p_name AS name, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1234.5 WHEN 3 THEN p_partkey + 0.7 END::DOUBLE AS metres, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1234 WHEN 3 THEN p_partkey END::BIGINT AS whole
FROM p WHERE p_size % 4 <> 0 AND p_partkey * 7 % 20011 IN (SELECT node FROM n)"""
)
def road_passes(spark, sf_dir):
    """Named passes on the nodes of ways, and the numbers in their tags."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS ord", "p_partkey * 7 % 20011 AS id", "46.0D AS lat", "7.0D AS lon", "CASE WHEN p_size % 4 != 0 THEN p_name END AS name",
        f"{PASS_TEXT} AS ele"
    )
    ways = view(spark, sf_dir, WAYS).select(F.transform(F.array("n0", "n1"), lambda n: F.concat_ws("/", F.lit("a"), n.cast("string"))).alias("nodes"))
    got = build.road_passes(_nodes(p, {"mountain_pass": "yes", "name": F.col("name"), "ele": F.col("ele")}), ways)
    return got.select("pass_id", "name", build.pass_metres(F.col("ele")).alias("metres"), build.whole_metres(F.col("ele")).alias("whole"))


@query(
    f"""WITH {CLASSES_SQL}, e AS (SELECT c.road, min(k) FILTER (cls > 0) AS lo, max(k) FILTER (cls > 0) AS hi, max(k) AS n FROM c GROUP BY c.road),
s AS (SELECT road, greatest(0, lo - 15) AS a, least(n, hi + 15) AS b FROM e WHERE lo IS NOT NULL),
t AS (SELECT s.road, s.a, s.b, (s.b - s.a) * 10.0::DOUBLE AS length, sum(CASE cls WHEN 1 THEN 0.01 WHEN 2 THEN 0.013 WHEN 3 THEN 0.016 WHEN 4 THEN 0.02 ELSE 0 END::DOUBLE) AS curvy FROM s JOIN c ON c.road = s.road AND c.k >= s.a AND c.k < s.b GROUP BY ALL)
SELECT road AS chain, a, b, length, round(curvy, 6) AS curvy FROM t WHERE length >= 600 AND round(curvy, 9) >= 0.3 AND curvy / (length / 1000) >= 0.7 ORDER BY round(curvy, 9) DESC, road::VARCHAR, a LIMIT 40"""
)
def candidate_sections(spark, sf_dir):
    """The forty curviest sections that are long and dense enough, of paths of some 600 metres."""
    s = sampling.bend_classes(view(spark, sf_dir, PATH)).withColumn("road", F.concat(F.lit("/"), F.col("road").cast("string")))
    return rounded(build.candidates(s, 40, 600, 0.3, 0.7).select(F.substring("chain", 2, 20).cast("long").alias("chain"), "a", "b", "length", "curvy"))


@query(
    f"""WITH {CLASSES_SQL}, z AS (SELECT road, count(*) AS n FROM c GROUP BY road), s AS (SELECT c.*, z.n, greatest(1, ceil((z.n - 1) / 20)) AS nb FROM c JOIN z USING (road)),
g AS (SELECT *, least(nb - 1, k // 20)::BIGINT AS slice FROM s)
SELECT road, slice AS i, count(*) FILTER (cls = 1 AND k < n - 1) AS c1, count(*) FILTER (cls = 2 AND k < n - 1) AS c2, count(*) FILTER (cls = 3 AND k < n - 1) AS c3, count(*) FILTER (cls = 4 AND k < n - 1) AS c4,
  count(*) FILTER (k % 3 = 0 AND k < n - 1) AS u, count(*) FILTER (k % 17 = 5) AS h, count(*) FILTER (k % 7 = 3) AS r FROM g GROUP BY road, slice"""
)
def slice_histogram(spark, sf_dir):
    """Samples of each class, built-up ones, hairpins and crests in each slice of 200 metres."""
    s = sampling.bend_classes(view(spark, sf_dir, PATH)).withColumn("urban", F.col("k") % 3 == 0)
    n = s.groupBy("road").agg(F.count("*").alias("n"))
    at = lambda m, r: s.where(F.col("k") % m == r).select("road", F.col("k").alias("at"))
    return rounded(build.slice_counts(s.join(n, "road"), at(17, 5), at(7, 3)))


Z_SQL = "(((cx * 7 + cy * 13) % 1000)::FLOAT)::DOUBLE"


@query(
    f"""WITH q AS ({POINTS}), p AS (SELECT point_id, (lon + 180) / 360 * 1048576 - 0.5 AS px, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 1048576 - 0.5 AS py FROM q),
c AS (SELECT point_id, floor(px)::BIGINT + dx AS cx, floor(py)::BIGINT + dy AS cy, CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END * CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END AS w
  FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT point_id, round(sum({Z_SQL} * w), 3) AS ele FROM c GROUP BY point_id"""
)
def terrain_at_points(spark, sf_dir):
    """Elevation between the four cells around each point, of tiles made by a rule."""
    p = view(spark, sf_dir, POINTS).select("point_id", "lon", "lat")
    edge = lambda c: F.shiftright(F.floor(c), 8)
    at = p.agg(
        F.min(edge(geo.pixel_x(F.col("lon")))).alias("x0"), F.max(edge(geo.pixel_x(F.col("lon"))) + 1).alias("x1"),
        F.min(edge(geo.pixel_y(F.col("lat")))).alias("y0"), F.max(edge(geo.pixel_y(F.col("lat"))) + 1).alias("y1")
    )
    tile = at.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    cells = F.expr("transform(sequence(0, 65535), c -> cast(((x * 256 + c % 256) * 7 + (y * 256 + c div 256) * 13) % 1000 AS float))")
    return rounded(elevation(p, tile.withColumn("metres", cells)).select("point_id", "ele"), 3)


RING_SQL = ", ".join(f"('ring', {j}, {r} * cos({j % 8} * pi() / 4), {r} * sin({j % 8} * pi() / 4))" for j, r in ((j, 800 if j < 8 else 1600) for j in range(16)))
SIDE_SQL = ", ".join(f"('side', {j}, {-s * m}, {s * m})" for j, (s, m) in enumerate((s, m) for s in (-1, 1) for m in (60, 120)))


@query(
    f"""WITH q AS ({POINTS}), p AS (SELECT *, cos(point_id) AS hx, sin(point_id) AS hy FROM q), o(what, j, dx, dy) AS (VALUES {RING_SQL}, {SIDE_SQL}),
a AS (SELECT point_id, what, j, lon, lat, CASE what WHEN 'ring' THEN dx ELSE dx * hy END AS east, CASE what WHEN 'ring' THEN dy ELSE dy * hx END AS north FROM p, o)
SELECT point_id AS k, what, j::BIGINT AS j, round(lon + east / ({EARTH} * cos(radians(lat))) * 180 / pi(), 7) AS lon, round(lat + north / {EARTH} * 180 / pi(), 7) AS lat FROM a"""
)
def ring_points(spark, sf_dir):
    """Points on two rings and at both sides of every point."""
    p = view(spark, sf_dir, POINTS).select(F.lit("r").alias("road"), F.col("point_id").alias("k"), "lon", "lat", F.cos("point_id").alias("hx"), F.sin("point_id").alias("hy"))
    return rounded(build.surroundings(p).drop("road"), 7)


@query(
    """WITH a AS (SELECT user_id AS road, CASE WHEN event_id % 5 = 0 THEN 'side' ELSE 'ring' END AS what, value * 10 AS ele FROM events), s AS (SELECT road, count(*) FILTER (what = 'ring' AND ele <= 840)::DOUBLE / nullif(count(*) FILTER (what = 'ring'), 0) AS open, min(ele) FILTER (what = 'side') AS low FROM a GROUP BY road)
SELECT road, round(least(9, open / 0.5 * 9), 6)::DOUBLE AS v, round(greatest(0, least(9, (900 - low - 25) / 70 * 9)), 6)::DOUBLE AS p FROM s"""
)
def slice_views(spark, sf_dir):
    """How open the ground falls away around a slice's centre, and how deep beside it."""
    a = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "user_id AS road", "0L AS k", "CASE WHEN event_id % 5 = 0 THEN 'side' ELSE 'ring' END AS what", "value * 10 AS ele"
    )
    one = a.select("road", "k").distinct()
    return rounded(build.views(one.withColumn("i", F.lit(0)), one.withColumn("ele", F.lit(900.0)), a).select("road", "v", "p"))


NAME_SQL = "CASE l_partkey % 4 WHEN 0 THEN 'Col' WHEN 1 THEN 'Alp' WHEN 2 THEN 'Rue' END"


@query(
    f"""WITH s AS (SELECT l_suppkey AS road, {NAME_SQL} AS name, sum(floor(l_quantity / 25)) AS m, min(l_orderkey * 10 + l_linenumber) AS j FROM lineitem GROUP BY ALL)
SELECT road, name, m::DOUBLE AS metres FROM s WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY road ORDER BY m DESC, j) = 1"""
)
def weighted_names(spark, sf_dir):
    """The name with most metres of each road, the one seen first on ties."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_suppkey AS road", f"{NAME_SQL} AS name", "l_orderkey * 10 + l_linenumber AS j", "cast(floor(l_quantity / 25) AS double) AS metres"
    )
    return build.weighted_mode(l, "name")


@query(
    """SELECT l_suppkey AS road, floor(100 * sum(l_quantity) FILTER (l_partkey % 5 = 0) / 20000 + 0.5::DOUBLE)::BIGINT AS narrow, floor(100 * sum(l_quantity) FILTER (l_partkey % 7 = 0) / 20000 + 0.5::DOUBLE)::BIGINT AS tunnel,
bool_or(l_orderkey % 997 = 0) AS toll, arg_min('c' || l_partkey, l_orderkey * 10 + l_linenumber) FILTER (l_partkey % 11 = 0) AS closed FROM lineitem GROUP BY l_suppkey"""
)
def road_warnings(spark, sf_dir):
    """Narrow and tunnel shares, tolls and the first closure along each road."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_suppkey AS road", "l_orderkey * 10 + l_linenumber AS j", "l_quantity AS metres", "20000D AS length", "l_partkey % 5 = 0 AS narrow",
        "l_partkey % 7 = 0 AS tunnel", "l_orderkey % 997 = 0 AS toll", "CASE WHEN l_partkey % 11 = 0 THEN concat('c', l_partkey) END AS closed"
    )
    return rounded(build.warnings(l))


def _lines(spark, sf_dir) -> DataFrame:
    """(road, points): each point with those of the next hundred ids of its label, in order; coordinates to five places."""
    p = view(spark, sf_dir, POINTS).select("point_id", "label", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), (F.col("point_id") % 997 * 3.0).alias("ele"))
    return p.groupBy(F.concat_ws("-", "label", F.floor(F.col("point_id") / 100)).alias("road")).agg(
        F.array_sort(F.collect_list(F.struct("point_id", "lon", "lat", "ele"))).alias("l")
    ).select("road", F.transform("l", lambda e: e.dropFields("point_id")).alias("coords"))


LINES_SQL = f"lp AS (SELECT label || '-' || (point_id // 100) AS road, point_id, round(lon, 5) AS lon, round(lat, 5) AS lat, (point_id % 997 * 3)::DOUBLE AS ele, row_number() OVER (PARTITION BY label, point_id // 100 ORDER BY point_id) - 1 AS j, count(*) OVER (PARTITION BY label, point_id // 100) AS n FROM ({POINTS}))"


@query(
    f"WITH {LINES_SQL} SELECT road, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, round((1.5 + 2.25 + 0.5 + 0.25) / (max(n) / 10), 6)::DOUBLE AS in_bends, arg_max(point_id, (ele, -j)) % 997 * 3.0::DOUBLE AS top FROM lp GROUP BY road"
)
def road_boxes(spark, sf_dir):
    """The box, the share of bends and the highest vertex of each line."""
    r = _lines(spark, sf_dir).withColumns({"bends": F.array(*map(F.lit, (1.5, 2.25, 0.5, 0.25))), "len": F.size("coords") * 100})
    return rounded(build.road_stats(r).select("road", "bb.w", "bb.s", "bb.e", "bb.n", "in_bends", views.highest_point(F.col("coords")).ele.alias("top")))


@query(
    f"""WITH {LINES_SQL}, e AS (SELECT road, n, first(ele ORDER BY j) AS a, last(ele ORDER BY j) AS b, first(lon ORDER BY j) AS lon0, last(lon ORDER BY j) AS lon1 FROM lp GROUP BY road, n)
SELECT road, a > b AS turned, greatest(a, b) AS climb, least(a, b) AS descent, CASE WHEN a > b THEN lon1 ELSE lon0 END AS lon, CASE WHEN a > b THEN 'B' ELSE 'A' END AS town, CASE WHEN a > b THEN n - 1 ELSE 0 END AS slice FROM e"""
)
def uphill_first(spark, sf_dir):
    """Lines that fall more than they climb, turned round with their towns and slices."""
    at = lambda i: F.element_at("coords", i).ele
    r = _lines(spark, sf_dir).withColumns({"climb": at(-1), "descent": at(1), "town0": F.lit("A"), "town1": F.lit("B"), "slices": F.sequence(F.lit(0), F.size("coords") - 1)})
    return rounded(
        build.uphill(r).select(
            "road", "turned", "climb", "descent", F.get("coords", F.lit(0)).lon.alias("lon"), F.col("town0").alias("town"),
            F.get("slices", F.lit(0)).alias("slice")
        )
    )


AT_SQL = "{a} AS (SELECT o_orderkey AS way, o_custkey AS road, o_orderkey % 2 = 1 AS reversed, 7 + o_orderkey * 37 % 1000 / 1000.0::DOUBLE AS lon, 46 + o_orderkey * 91 % 1000 / 1000.0::DOUBLE AS lat FROM orders)"
GEOMETRY = "array(struct({lat} AS lat, {lon} AS lon), struct({lat} + 0.01D AS lat, {lon} AS lon), struct({lat} + 0.01D AS lat, {lon} AS lon), struct({lat} + 0.02D AS lat, {lon} + 0.03D AS lon))"


def _order_ways(spark, sf_dir) -> DataFrame:
    g = GEOMETRY.format(lat="(46 + o_orderkey * 91 % 1000 / 1000D)", lon="(7 + o_orderkey * 37 % 1000 / 1000D)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS way", "o_custkey AS road", "o_orderkey % 2 = 1 AS reversed", f"{g} AS geometry")


@query(
    f"""WITH {AT_SQL.format(a='o')}, d AS (SELECT way, lon, lat, -0.03::DOUBLE * cos(radians(lat)) AS x0, -0.02::DOUBLE AS y0, 0.03::DOUBLE * cos(radians(lat + 0.02::DOUBLE)) AS x1, 0.02::DOUBLE AS y1 FROM o)
SELECT way, round(x0 / {span('x0', 'y0')}, 6) AS dx0, round(y0 / {span('x0', 'y0')}, 6) AS dy0, round(x1 / {span('x1', 'y1')}, 6) AS dx1, round(y1 / {span('x1', 'y1')}, 6) AS dy1 FROM d"""
)
def end_directions(spark, sf_dir):
    """The directions of every way at its two ends."""
    w = _order_ways(spark, sf_dir).select("way", build.end_direction(F.col("geometry"), True).alias("s"), build.end_direction(F.col("geometry"), False).alias("e"))
    return rounded(w.select("way", F.col("s.dx").alias("dx0"), F.col("s.dy").alias("dy0"), F.col("e.dx").alias("dx1"), F.col("e.dy").alias("dy1")))


@query(
    f"""WITH {AT_SQL.format(a='o')}, c AS (SELECT *, row_number() OVER (PARTITION BY road ORDER BY way) - 1 AS pos FROM o),
v AS (SELECT c.road, c.pos, c.way, CASE WHEN reversed THEN 3 - k ELSE k END AS j, lat + CASE k WHEN 0 THEN 0 WHEN 3 THEN 0.02 ELSE 0.01 END::DOUBLE AS lat, lon + CASE k WHEN 3 THEN 0.03 ELSE 0 END::DOUBLE AS lon FROM c, range(0, 4) r(k)),
w AS (SELECT * FROM v WHERE pos = 0 OR j > 0), z AS (SELECT *, cos(radians(avg(lat) OVER (PARTITION BY road))) AS c0 FROM w),
x AS (SELECT *, radians(lon) * {EARTH} * c0 AS x, radians(lat) * {EARTH} AS y FROM z),
g AS (SELECT *, {span('x - lag(x) OVER o', 'y - lag(y) OVER o')} AS gap FROM x WINDOW o AS (PARTITION BY road ORDER BY pos, j))
SELECT road, count(*)::BIGINT AS vertices, round(sum(gap), 2) AS metres, sum(way)::BIGINT AS ways FROM g WHERE gap IS NULL OR gap > 0.01 GROUP BY road"""
)
def chain_lines(spark, sf_dir):
    """The lines of chains: ways turned where they are entered at their end, joined at shared vertices, without doubled points."""

    w = _order_ways(spark, sf_dir)
    chain = w.withColumn("pos", F.row_number().over(Window.partitionBy("road").orderBy("way")) - 1).drop("geometry")
    got = build.chain_vertices(chain, w.select("way", "geometry"))
    return rounded(got.groupBy("road").agg(F.count("*").alias("vertices"), F.max("d").alias("metres"), F.sum("way").alias("ways")), 2)


EVENT_LINE = "SELECT user_id AS road, event_id AS way, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value FROM events"


@query(
    f"""WITH e AS ({EVENT_LINE}), v AS (SELECT *, (10 * k + way % 7)::DOUBLE AS d FROM e)
SELECT q.way AS id, coalesce((SELECT arg_min(v.way, v.d) FROM v WHERE v.road = q.road AND v.d >= q.d + 4), (SELECT arg_max(v.way, v.d) FROM v WHERE v.road = q.road)) AS way FROM v q"""
)
def way_owners(spark, sf_dir):
    """The vertex that owns each of some places along a road, by distance."""
    v = spark.sql(
        EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet")
    ).selectExpr("road", "way", "cast(10 * k + way % 7 AS double) AS d")
    return build.owners(v, v.select("road", (F.col("d") + 4).alias("d"), F.col("way").alias("id"))).select("id", "way")


PLANE_SQL = f"{span('(lon - plon) * cos(radians(plat))', 'lat - plat')} * radians(1) * {EARTH}"


@query(
    f"""WITH {LINES_SQL}, p AS (SELECT *, lag(lon) OVER o AS plon, lag(lat) OVER o AS plat, lag(ele) OVER o AS pele FROM lp WHERE n > 1 WINDOW o AS (PARTITION BY road ORDER BY j)),
d AS (SELECT *, coalesce(sum({PLANE_SQL}) OVER (PARTITION BY road ORDER BY j), 0) AS d FROM p), g AS (SELECT *, lag(d) OVER (PARTITION BY road ORDER BY j) AS d0, max(d) OVER (PARTITION BY road) AS total FROM d),
c AS (SELECT road, i, (i + 0.5::DOUBLE) * total / 20 AS x FROM (SELECT DISTINCT road, total FROM g), range(0, 20) r(i))
SELECT c.road, c.i, round(pele + (ele - pele) * (x - d0) / (d - d0), 4) AS ele FROM c JOIN g ON g.road = c.road AND g.d0 <= c.x AND g.d > c.x"""
)
def slice_heights(spark, sf_dir):
    """Elevation at the centres of twenty slices along each line."""
    c = _lines(spark, sf_dir).where("size(coords) > 1").select("road", F.posexplode("coords").alias("j", "p")).select("road", "j", "p.*").withColumn("nb", F.lit(20))
    return rounded(build.slice_elevation(c), 4)


@query()
def built_roads(spark, sf_dir):
    """From elements to ranked roads: a way for each supplier, turning by its line items, on hills made by a rule."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = spark.sql(
        """SELECT l_suppkey AS id, i, sum(12 * cos(radians(turn))) OVER w AS x, sum(12 * sin(radians(turn))) OVER w AS y FROM (
  SELECT l_suppkey, row_number() OVER o - 1 AS i, sum((l_partkey * 7919 + l_orderkey * 31) % 41 - 20 + 12 * sign(sin(l_suppkey + l_linenumber))) OVER o AS turn FROM {l}
  WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) s WINDOW w AS (PARTITION BY l_suppkey ORDER BY i)""",
        l=l,
    )
    lon, lat = 7 + F.col("id") % 10 * 0.02 + F.col("x") / 77_000, 46 + F.floor(F.col("id") / 10) % 10 * 0.02 + F.col("y") / 111_000
    points = line.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", lat.alias("lat"), lon.alias("lon")))).alias("l"))
    tags = F.create_map(F.lit("name"), F.concat(F.lit("Road "), "id"), F.lit("ref"), F.concat(F.lit("D "), F.col("id") % 7))
    none = F.lit(None).cast("double")
    elements = points.select(
        F.lit("a").alias("area"), F.col("id").alias("ord"), F.lit("way").alias("type"), "id",
        F.transform("l", lambda e: F.col("id") * 100_000 + e.i).alias("nodes"), F.transform("l", lambda e: e.dropFields("i")).alias("geometry"),
        none.alias("lat"), none.alias("lon"), tags.alias("tags")
    )
    tile = spark.range(2120, 2145).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(1435), F.lit(1465))).alias("y"))
    hills = F.expr("transform(sequence(0, 65535), c -> cast(900 + 300 * sin((x * 256 + c % 256) / 40) + 250 * cos((y * 256 + c div 256) / 55) AS float))")
    found = build.find_roads(elements, tile.withColumn("metres", hills))
    return rounded(found.select("place", "name", "len", "score", "hairpins", "climb", F.size("slices").alias("slices")))


# ---------------------------------------------------------------- distances

@query(f"WITH q AS ({POINTS}) SELECT DISTINCT a.point_id FROM q a JOIN (SELECT lon + 0.002 AS lon, lat AS lat FROM q) b ON true WHERE {DIST_SQL} < 200")
def near_viewpoints(spark, sf_dir):
    p = view(spark, sf_dir, POINTS)
    return spatial.near_points(p, p.select((F.col("lon") + 0.002).alias("p_lon"), F.col("lat").alias("p_lat")), 200.0)


@query(
    f"""WITH q AS ({POINTS}), r AS (SELECT label % 3 AS road, point_id, lon, lat, row_number() OVER (PARTITION BY label % 3 ORDER BY point_id) - 1 AS j, count(*) OVER (PARTITION BY label % 3) AS n FROM q),
s AS (SELECT * FROM r WHERE j % greatest(1, ceil(n / 120)) = 0 OR j = n - 1), b AS (SELECT point_id, lon + 0.002 AS lon, lat FROM q), f AS (SELECT DISTINCT a.road, b.point_id FROM s a JOIN b ON true WHERE {DIST_SQL} <= 200)
SELECT road, point_id FROM f QUALIFY row_number() OVER (PARTITION BY road ORDER BY point_id) <= 80"""
)
def stops_near(spark, sf_dir):
    """Up to eighty places to stop within 200 metres of some 120 vertices of each road."""

    p = view(spark, sf_dir, POINTS).withColumn("road", F.col("label") % 3)
    w = Window.partitionBy("road")
    c = p.select("road", (F.row_number().over(w.orderBy("point_id")) - 1).alias("j"), F.count("*").over(w).alias("n"), "lon", "lat")
    return rounded(views.stops_near(c, p.select("point_id", (F.col("lon") + 0.002).alias("p_lon"), F.col("lat").alias("p_lat"))))


@query(
    f"""WITH q AS ({POINTS}), r AS (SELECT point_id AS road, lon AS w, lat AS s, lon + 0.01 AS e, lat + 0.01 AS n, 35 / 111320.0::DOUBLE AS py, 35 / (111320 * cos(radians(greatest(abs(lat), abs(lat + 0.01))))) AS px FROM q),
t AS (SELECT point_id // 2 AS ride, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM q WHERE label < 4 GROUP BY 1)
SELECT DISTINCT road FROM r JOIN t ON t.w <= r.e + px AND t.e >= r.w - px AND t.s <= r.n + py AND t.n >= r.s - py"""
)
def ride_boxes(spark, sf_dir):
    """Roads whose padded box meets that of a ride."""
    p = view(spark, sf_dir, POINTS)
    roads = p.select(
        F.col("point_id").alias("road"),
        F.struct(F.col("lon").alias("w"), F.col("lat").alias("s"), (F.col("lon") + 0.01).alias("e"), (F.col("lat") + 0.01).alias("n")).alias("bb")
    )
    return spatial.near_ride_boxes(
        roads, p.where("label < 4").select(F.floor(F.col("point_id") / 2).alias("ride"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    ).select("road")


# ---------------------------------------------------------------- tiles

TILE_SQL = "floor({lat})::BIGINT || '_' || floor({lon})::BIGINT"


@query(
    f"""WITH q AS ({POINTS}), e AS (SELECT {TILE_SQL.format(lat='lat', lon='lon')} AS tile, point_id AS ord, point_id % 300 AS id, CASE WHEN point_id % 3 = 0 THEN 'way' ELSE 'node' END AS type, lon, lat FROM q),
t AS (SELECT DISTINCT tile, split_part(tile, '_', 1)::BIGINT AS y, split_part(tile, '_', 2)::BIGINT AS x FROM e),
m AS (SELECT a.tile AS area, e.*, ((b.y - a.y + 1) * 3 + b.x - a.x + 1) * 1099511627776 + e.ord AS place FROM t a JOIN t b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 JOIN e ON e.tile = b.tile
  WHERE e.lat BETWEEN a.y - 0.15::DOUBLE AND a.y + 1.15::DOUBLE AND e.lon BETWEEN a.x - 0.15::DOUBLE AND a.x + 1.15::DOUBLE OR e.type = 'way' AND e.lat + 0.1::DOUBLE BETWEEN a.y - 0.15::DOUBLE AND a.y + 1.15::DOUBLE AND e.lon BETWEEN a.x - 0.15::DOUBLE AND a.x + 1.15::DOUBLE),
l AS (SELECT area, type, id, arg_max(ord, place) AS taken, min(place) AS place FROM m GROUP BY ALL)
SELECT area, type, id, taken, row_number() OVER (PARTITION BY area ORDER BY place) - 1 AS ord FROM l"""
)
def tile_elements(spark, sf_dir):
    """Elements of a tile's own file and of its neighbours', as far as they meet its padded box, without doubles."""
    p = view(spark, sf_dir, POINTS)
    line = F.array(F.struct("lat", "lon"), F.struct((F.col("lat") + 0.1).alias("lat"), "lon"))
    way = F.col("point_id") % 3 == 0
    e = p.select(
        sets.tile_key(F.col("lon"), F.col("lat")).alias("tile"), F.col("point_id").alias("ord"), F.when(way, "way").otherwise("node").alias("type"),
        (F.col("point_id") % 300).alias("id"), F.when(way, line).alias("geometry"), F.when(~way, F.col("lat")).alias("lat"),
        F.when(~way, F.col("lon")).alias("lon"), F.create_map(F.lit("taken"), F.col("point_id").cast("string")).alias("tags")
    )
    got = tiles.tile_elements(e, e.select("tile").distinct())
    return got.select("area", "type", "id", F.col("tags")["taken"].cast("long").alias("taken"), "ord")


@query(
    f"""WITH a AS (SELECT *, ceil((n - s) / 0.06::DOUBLE - 1e-9) AS rows, ceil((e - w) / 0.06::DOUBLE - 1e-9) AS cols FROM ({AREAS}))
SELECT area_ord::BIGINT AS area_ord, i, j, round(s + (n - s) * i / rows, 9) AS south, round(w + (e - w) * (j + 1) / cols, 9) AS east FROM a, range(0, 9) x(i), range(0, 9) y(j) WHERE i < rows AND j < cols"""
)
def area_cells(spark, sf_dir):
    """Areas cut into cells of about 0.06 degrees."""
    a = view(spark, sf_dir, AREAS).select("area_ord", F.struct(*(F.col(c).cast("double").alias(c) for c in "swne")).alias("box"))
    return rounded(tiles.cells_of(a, 0.06).select("area_ord", "i", "j", F.col("cell_box.s").alias("south"), F.col("cell_box.e").alias("east")), 9)


@query(
    f"""WITH q AS ({POINTS}), s AS (SELECT DISTINCT floor(lat / 0.25::DOUBLE)::BIGINT AS i, floor(lon / 0.25::DOUBLE)::BIGINT AS j FROM q), b AS (SELECT i // 3 AS bi, j // 4 AS bj, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM s GROUP BY ALL)
SELECT bi, bj, i0 * 0.25::DOUBLE AS south, (j1 + 1) * 0.25::DOUBLE AS east, (i1 - i0 + 1) * (j1 - j0 + 1) AS squares, i0 || '_' || j0 AS first_key FROM b"""
)
def scan_pieces(spark, sf_dir):
    """The squares that points lie in, grouped into pieces to fetch."""
    p = view(spark, sf_dir, POINTS).select(geo.cell(F.col("lat"), 0.25).alias("i"), geo.cell(F.col("lon"), 0.25).alias("j")).distinct()
    return rounded(
        tiles.pieces(p).select("bi", "bj", F.col("box.s").alias("south"), F.col("box.e").alias("east"), F.size("keys").alias("squares"), F.get("keys", F.lit(0)).alias("first_key"))
    )


@query(
    f"WITH a AS ({AREAS}) SELECT area_ord::BIGINT AS area_ord, i, j FROM a, range(170, 200) y(i), range(20, 40) x(j) WHERE i BETWEEN floor(s / 0.25::DOUBLE) AND floor(n / 0.25::DOUBLE) AND j BETWEEN floor(w / 0.25::DOUBLE) AND floor(e / 0.25::DOUBLE)"
)
def wanted_squares(spark, sf_dir):
    a = view(spark, sf_dir, AREAS).select("area_ord", F.struct("s", "w", "n", "e").alias("box"))
    return rounded(tiles.wanted_squares(a).select("area_ord", "i", "j"))


@query(f"WITH {LINES_SQL} SELECT DISTINCT road, floor(lat / 0.25::DOUBLE)::BIGINT || '_' || floor(lon / 0.25::DOUBLE)::BIGINT AS square FROM lp")
def filed_elements(spark, sf_dir):
    """Lines under every square that they touch, and lines to flat numbers and back."""
    e = _lines(spark, sf_dir).select(
        "road", F.lit("way").alias("type"), F.transform("coords", lambda c: F.struct(c.lat.alias("lat"), c.lon.alias("lon"))).alias("geometry"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")
    )
    e = e.withColumn("geometry", texts.line_of(texts.flat_line(F.col("geometry"))))
    return tiles.filed(e).select("road", "square")


TILED_SQL = f"{LINES_SQL}, m AS (SELECT road, n, max(lon) FILTER (j = n // 2) AS mlon, max(lat) FILTER (j = n // 2) AS mlat, min(lon) AS w, max(lat) AS north, min(point_id) AS first_id FROM lp GROUP BY road, n), tr AS (SELECT *, '46_' || (6 + first_id % 2) AS area, first_id % 97 AS score FROM m), own AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY first_id) AS pos FROM tr WHERE score >= 15 AND mlat >= 46 AND mlat < 47 AND mlon >= split_part(area, '_', 2)::INT AND mlon < split_part(area, '_', 2)::INT + 1)"


def _tile_roads(spark, sf_dir) -> DataFrame:
    first = view(spark, sf_dir, POINTS).groupBy(F.concat_ws("-", "label", F.floor(F.col("point_id") / 100)).alias("road")).agg(F.min("point_id").alias("place"))
    r = _lines(spark, sf_dir).join(first, "road").withColumns({"area": F.concat(F.lit("46_"), 6 + F.col("place") % 2), "score": F.col("place") % 97, "id": F.col("road")})
    none = {c: F.lit(None).cast("string") for c in ("name", "road_text", "from", "to")}
    return r.withColumns(none | {"len": F.lit(0), "hairpins": F.lit(0), "ele_max": F.lit(0), "pass": F.struct(F.lit("P").alias("name"))})


@query(f"WITH {TILED_SQL} SELECT area, road, pos FROM own WHERE pos <= 60")
def tile_output(spark, sf_dir):
    """The roads that each tile owns and keeps."""
    return rounded(tiles.tile_output(_tile_roads(spark, sf_dir), most=60).select("area", "road", "pos"))


@query(
    f"WITH {TILED_SQL} SELECT road AS id, area AS tile, round(w, 4) AS w, round(north, 4) AS n, pass_name, score, first_id * 7 % 101 AS bit_score FROM own, (SELECT 'P' AS pass_name) WHERE pos <= 60 ORDER BY bit_score DESC, score DESC, area, pos LIMIT 25"
)
def tile_bits(spark, sf_dir):
    """The best bits of all tiles."""
    r = tiles.tile_output(_tile_roads(spark, sf_dir), most=60)
    bits = r.select("area", "id", (F.col("place") * 7 % 101).alias("bit_score"), F.lit(0).alias("from_m"), F.lit(5000).alias("to_m"))
    top = tiles.top_bits(tiles.bit_entries(r, bits), 25)
    return rounded(top.select("id", "tile", "bb.w", "bb.n", "pass_name", "score", "bit_score"))


@query(
    """WITH b AS (SELECT o_orderkey // 1000 % 60 AS t, o_custkey % 5 AS v, o_orderkey AS id, o_custkey * 31 % 101 AS score, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 17 % 97 END AS bit FROM orders),
k AS (SELECT t, max(v) AS v FROM b GROUP BY t), c AS (SELECT b.* FROM b JOIN k ON k.t = b.t AND k.v = b.v),
m AS (SELECT * FROM c WHERE bit IS NOT NULL ORDER BY bit DESC, score DESC, 'q' || t, id LIMIT 300)
SELECT 'q' || c.t AS tile, max(c.v)::BIGINT AS version, count(*) AS roads, md5(string_agg('r' || c.id, ',' ORDER BY c.id)) AS ids, (SELECT count(*) FROM m WHERE m.t = c.t) AS bits FROM c GROUP BY c.t"""
)
def followed_tiles(spark, sf_dir):
    """The index and best bits of tiles after five versions of many of them have come in, in batches out of order."""
    path = shared_dir(spark, "tiles")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('q', cast(floor(o_orderkey / 1000) AS bigint) % 60) AS tile", "o_custkey % 5 AS version", "o_orderkey AS pos", "concat('r', o_orderkey) AS id", "o_custkey * 31 % 101 AS score", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 17 % 97 END AS bit_score"
    )
    for versions in ((1, 3), (0, 2), (4,)):
        followed.apply_changes(o.where(F.col("version").isin(*versions)), path)
    bits = followed.bits_of(spark, path).groupBy(F.col("tile").cast("string").alias("tile")).agg(F.count("*").alias("bits"))
    return followed.index_of(spark, path).join(bits, "tile", "left").select("tile", "version", "roads", F.md5("ids").alias("ids"), F.coalesce("bits", F.lit(0)).alias("bits"))


@query("SELECT (s_suppkey % 700)::VARCHAR AS id, arg_max('t' || s_nationkey, s_nationkey) AS tile FROM supplier GROUP BY s_suppkey % 700")
def id_tiles(spark, sf_dir):
    """Which tile holds each id of an index."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("tile"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 700).alias("road_id"))
    return tiles.tile_of_ids(tile_index(s).select(F.col("tile").alias("tile_ord"), F.concat(F.lit("t"), "tile").alias("tile"), "ids"))


@query(
    f"""WITH q AS ({POINTS}), e AS (SELECT point_id AS id, lon, lat, point_id % 2 AS way, CASE point_id % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'track' WHEN 2 THEN 'trunk' WHEN 3 THEN 'unclassified' END AS highway, CASE point_id % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'hamlet' END AS place, point_id % 11 = 0 AS view FROM q)
SELECT id FROM e WHERE CASE WHEN way = 1 THEN highway IN ('primary', 'trunk', 'unclassified') AND (lat BETWEEN 45.95::DOUBLE AND 46.05::DOUBLE AND lon BETWEEN 6.9::DOUBLE AND 7.1::DOUBLE OR lat + 0.1::DOUBLE BETWEEN 45.95::DOUBLE AND 46.05::DOUBLE AND lon BETWEEN 6.9::DOUBLE AND 7.1::DOUBLE)
  ELSE lat BETWEEN 45.95::DOUBLE AND 46.05::DOUBLE AND lon BETWEEN 6.9::DOUBLE AND 7.1::DOUBLE AND (place = 'city' OR view) END"""
)
def requested_elements(spark, sf_dir):
    """Elements that a request for a box holds."""
    return requested(_point_elements(spark, sf_dir), 45.95, 6.9, 46.05, 7.1).select("id")


def _point_elements(spark, sf_dir):
    p = view(spark, sf_dir, POINTS)
    way = F.col("point_id") % 2 == 1
    line = F.array(F.struct("lat", "lon"), F.struct((F.col("lat") + 0.1).alias("lat"), "lon"))
    tags = {
        "highway": F.when(way, F.get(F.array(*map(F.lit, ("primary", "track", "trunk", "unclassified"))), (F.col("point_id") % 7).cast("int"))),
        "place": F.when(F.col("point_id") % 5 == 0, "city").when(F.col("point_id") % 5 == 1, "hamlet"),
        "tourism": F.when(F.col("point_id") % 11 == 0, "viewpoint")
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in tags.items()))
    return p.select(
        F.col("point_id").alias("id"), F.when(way, "way").otherwise("node").alias("type"), F.when(way, line).alias("geometry"),
        F.when(~way, F.col("lat")).alias("lat"), F.when(~way, F.col("lon")).alias("lon"),
        F.map_from_entries(F.filter(pairs, lambda x: x.v.isNotNull())).alias("tags")
    )

# ---------------------------------------------------------------- the list

ROADS = """SELECT c_custkey AS ord, 'r' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS road_text, 'n' || c_nationkey AS "from", CASE WHEN c_custkey % 4 = 0 THEN 'Town' END AS "to", CASE WHEN c_custkey % 5 = 0 THEN 'Col ' || c_custkey END AS pass_name,
  c_custkey * 37 % 101 AS score, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 53 % 101 END AS bit, c_custkey * 11 % 89 AS scenery, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS in_bends, c_nationkey AS hairpins, c_custkey % 1500 AS climb, c_custkey * 3 % 2800 AS ele_max, c_custkey * 17 % 30000 AS len FROM customer"""
MARKS = "SELECT 'r' || doc_id AS id, quality = 1 AS fav, toxic = 1 AS ridden, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS rating FROM labels"
#: Each sort key with a mode and words of its own.
LISTS = (
    ("score", "all", ""), ("bit", "passes", ""), ("scenery", "fav", "1"), ("in_bends", "ridden", ""), ("hairpins", "unridden", "TOWN"),
    ("climb", "rated", ""), ("ele_max", "all", " col "), ("len", "all", "auto")
)
MODE_SQL = {
    "all": "true", "passes": "pass_name IS NOT NULL", "fav": "id IN (SELECT id FROM k WHERE fav)", "ridden": "id IN (SELECT id FROM k WHERE ridden)",
    "unridden": "id NOT IN (SELECT id FROM k WHERE ridden)", "rated": "id IN (SELECT id FROM k WHERE rating <> 0)"
}


def _has(text: str, fields: tuple[str, ...]) -> str:
    return f"contains(lower(concat_ws(chr(1), {', '.join(fields)})), '{text.strip().lower()}')" if text.strip() else "true"


def _roads(spark, sf_dir) -> DataFrame:
    return spark.sql(ROADS.replace('"', "`").replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _marks(spark, sf_dir) -> DataFrame:
    return spark.sql(MARKS.replace("FROM labels", "FROM {l}"), l=spark.read.parquet(f"{sf_dir}/labels.parquet"))


LIST_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{sort}' AS list, id, coalesce({sort}, 0)::DOUBLE AS value FROM r WHERE {MODE_SQL[show]} AND {
        _has(words, ('name', 'road_text', chr(34) + 'from' + chr(34), chr(34) + 'to' + chr(34), 'pass_name'))
    } ORDER BY value DESC, ord LIMIT 300)" for sort, show, words in LISTS
)


#: Words of one letter to twenty, some of them in no text.
WORDS = ("0", "a", "co", "auto", "col 1", "mobile", "town", "n1", "customer#0000000", "customer#000000011", "household", "zz", "col 15", "000000000000000001", "omer#00000000012")


@query(
    f"""WITH r AS ({ROADS}), q(word) AS (VALUES {", ".join(f"('{x}')" for x in WORDS)})
SELECT word, id FROM q JOIN r ON contains(lower(coalesce(name, '')), word) OR contains(lower(coalesce(road_text, '')), word) OR contains(lower(coalesce("from", '')), word) OR contains(lower(coalesce("to", '')), word) OR contains(lower(coalesce(pass_name, '')), word)"""
)
def searched_roads(spark, sf_dir):
    """Roads in whose texts words stand, by the index of their pieces."""
    roads, out = _roads(spark, sf_dir), None
    index = stored(listing.text_index(roads), "grams")
    for word in WORDS:
        one = listing.indexed_roads(roads, index, word).select(F.lit(word).alias("word"), "id")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"WITH r AS ({ROADS}), k AS ({MARKS}) {LIST_SQL}")
def listed_roads(spark, sf_dir):
    """A list by every sort key, with every mode and words."""
    roads, marks, out = _roads(spark, sf_dir), _marks(spark, sf_dir), None
    for sort, show, words in LISTS:
        one = listing.road_list(roads, sort, words, show, marks).select(F.lit(sort).alias("list"), "id", F.coalesce(sort, F.lit(0)).cast("double").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query(
    f"""WITH r AS (SELECT * FROM ({ROADS}) WHERE ord % 3 <> 1), e AS (SELECT 'r' || c_custkey AS id, c_custkey AS ord, c_name AS name, c_custkey * 29 % 103 AS bit FROM customer WHERE c_custkey % 2 = 1), k AS ({MARKS}),
u AS (SELECT id, ord, bit, 0 AS stub FROM r WHERE bit IS NOT NULL AND id IN (SELECT id FROM k WHERE fav) UNION ALL SELECT id, ord, bit, 1 FROM e WHERE id NOT IN (SELECT id FROM r) AND id IN (SELECT id FROM k WHERE fav))
SELECT id, bit::BIGINT AS bit, stub = 1 AS stub FROM u ORDER BY bit DESC, stub, ord LIMIT 300"""
)
def list_with_stubs(spark, sf_dir):
    """Favourites by their best bit, with stubs of those that are not loaded."""
    loaded = _roads(spark, sf_dir).where("ord % 3 != 1")
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 1").selectExpr(
        "concat('r', c_custkey) AS id", "c_custkey AS ord", "c_name AS name", "c_custkey * 29 % 103 AS bit",
        *(f"cast(NULL AS string) AS `{c}`" for c in ("road_text", "from", "to", "pass_name"))
    )
    return rounded(listing.road_list(loaded, "bit", "", "fav", _marks(spark, sf_dir), entries).select("id", "bit", "stub"))


@query(f"""WITH q AS ({POINTS}), r AS (SELECT point_id, point_id % 101 AS score, lon AS w, lat AS s, lon + 0.05 AS e, lat + 0.05 AS n FROM q)
SELECT point_id, z AS zoom, score >= 55 AS glow, s <= 46.1::DOUBLE AND n >= 45.9::DOUBLE AND w <= 7.2::DOUBLE AND e >= 7 AS in_view FROM r, (VALUES (7), (8), (9)) v(z) WHERE score >= CASE z WHEN 7 THEN 45 WHEN 8 THEN 30 ELSE 0 END AND point_id <> 17""")
def drawn_roads(spark, sf_dir):
    """What a map draws at three zooms, and what of it is in view."""
    p = view(spark, sf_dir, POINTS).select(
        F.col("point_id").alias("id"), (F.col("point_id") % 101).alias("score"),
        F.struct(F.col("lat").alias("s"), F.col("lon").alias("w"), (F.col("lat") + 0.05).alias("n"), (F.col("lon") + 0.05).alias("e")).alias("bb")
    )
    out = None
    for zoom in (7, 8, 9):
        one = listing.drawn(p, float(zoom), 17).select(
            F.col("id").alias("point_id"), F.lit(zoom).alias("zoom"), "glow",
            listing.boxes_meet(F.col("bb"), F.lit(45.9), F.lit(7.0), F.lit(46.1), F.lit(7.2)).alias("in_view")
        )
        out = one if out is None else out.unionAll(one)
    return rounded(out)


@query(
    f"WITH q AS (SELECT point_id, round(lon, 1) AS lon, round(lat, 1) AS lat FROM ({POINTS})) SELECT min(point_id) AS ord, lon, lat FROM q WHERE lat BETWEEN 45.9::DOUBLE AND 46.1::DOUBLE AND lon BETWEEN 6.9::DOUBLE AND 7.2::DOUBLE GROUP BY lon, lat"
)
def passes_in_view(spark, sf_dir):
    """The first pass at each place in a box."""
    p = view(spark, sf_dir, POINTS).select(F.col("point_id").alias("ord"), F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat"))
    return listing.passes_in(sets.distinct_passes(p), 45.9, 6.9, 46.1, 7.2).select("ord", "lon", "lat")


@query(
    f"SELECT label::BIGINT AS pointer, max(point_id % 37) AS score, min(point_id) FILTER (point_id % 37 = m) AS ord FROM (SELECT *, max(point_id % 37) OVER (PARTITION BY label) AS m FROM ({POINTS})) GROUP BY label"
)
def top_features(spark, sf_dir):
    p = view(spark, sf_dir, POINTS).select(F.col("label").alias("pointer"), F.col("point_id").alias("ord"), (F.col("point_id") % 37).alias("score"))
    return rounded(listing.top_feature(p, ["pointer"]))


@query(
    f"""WITH q AS (SELECT label, point_id, floor(lon * 8)::INT / 8 AS lon, floor(lat * 8)::INT / 8 AS lat FROM ({POINTS})),
l AS (SELECT label, string_agg('[' || lon::DOUBLE || ',' || lat::DOUBLE || ']', ',' ORDER BY point_id) AS c, min(lat)::DOUBLE AS s, min(lon)::DOUBLE AS w, max(lat)::DOUBLE AS n, max(lon)::DOUBLE AS e FROM q GROUP BY label)
SELECT label::BIGINT AS label, '{{"type":"Feature","properties":{{"name":"Ride ' || label || '"}},"geometry":{{"type":"LineString","coordinates":[' || c || ']}}}}' AS ride,
  '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || c || ']}}}}' AS hot, s, w, n, e, CASE WHEN label % 2 = 0 THEN 'r' || label END AS road FROM l"""
)
def ride_features(spark, sf_dir):
    """Rides and stretches as GeoJSON, the boxes of their points, and the roads that links to them name."""
    p = view(spark, sf_dir, POINTS).select("label", "point_id", (F.floor(F.col("lon") * 8) / 8).alias("lon"), (F.floor(F.col("lat") * 8) / 8).alias("lat"))
    lines = p.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("point_id", "lon", "lat"))).alias("points"))
    link = F.when(F.col("label") % 2 == 0, F.concat(F.lit("#scan=46.000,7.000,30&road=r"), "label")).otherwise("#scan=46.000,7.000,30")
    box = texts.box_of(F.col("points"))
    return lines.select(
        F.col("label").cast("long").alias("label"), tracks.ride_feature(F.concat(F.lit("Ride "), "label"), F.col("points")).alias("ride"),
        tracks.hot_feature(F.col("points")).alias("hot"), *(box[c].alias(c) for c in "swne"), texts.linked_road(link).alias("road"),
    )


PLACE_SQL = "SELECT c_nationkey AS query, c_custkey AS ord, CASE WHEN c_custkey % 6 = 0 THEN 'highway' WHEN c_custkey % 6 < 5 THEN 'place' END AS osm_key, CASE c_custkey % 11 WHEN 1 THEN 'hamlet' WHEN 2 THEN 'suburb' WHEN 3 THEN 'village' WHEN 4 THEN 'isolated' END AS osm_value FROM customer"


@query(
    f"""WITH p AS ({PLACE_SQL}), r AS (SELECT *, CASE WHEN osm_key IS DISTINCT FROM 'place' THEN 9 WHEN osm_value = 'village' THEN 3 WHEN osm_value = 'suburb' THEN 5 WHEN osm_value = 'hamlet' THEN 6 ELSE 8 END AS rank FROM p)
SELECT query::BIGINT AS query, ord, rank::BIGINT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, ord) = 1"""
)
def best_places(spark, sf_dir):
    """The place that each search takes."""
    p = spark.sql(PLACE_SQL.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return rounded(listing.best_place(p).select("query", "ord", "rank"))


@query("SELECT 'roads' AS what, count(*) AS n FROM supplier UNION ALL SELECT 'rides', count(*) FROM customer UNION ALL SELECT 'ratings', count(*) FROM labels")
def table_counts(spark, sf_dir):
    return listing.counts({n: spark.read.parquet(f"{sf_dir}/{t}.parquet") for n, t in (("roads", "supplier"), ("rides", "customer"), ("ratings", "labels"))})


KINDS_SQL = "CASE p_size % 9 WHEN 0 THEN 'cafe' WHEN 1 THEN 'restaurant' WHEN 2 THEN 'pub' WHEN 3 THEN 'fuel' WHEN 4 THEN 'biergarten' WHEN 5 THEN 'bank' END"


@query(f"""WITH p AS (SELECT p_partkey AS id, {KINDS_SQL} AS amenity, CASE WHEN p_size % 9 = 6 THEN 'alpine_hut' END AS tourism FROM part)
SELECT id, CASE amenity WHEN 'cafe' THEN 'coffee' WHEN 'restaurant' THEN 'fork-knife' WHEN 'pub' THEN 'beer-stein' WHEN 'biergarten' THEN 'beer-stein' WHEN 'fuel' THEN 'gas-pump' ELSE CASE WHEN tourism IS NOT NULL THEN 'house-line' ELSE 'map-pin' END END AS icon,
  CASE amenity WHEN 'cafe' THEN 'Café' WHEN 'restaurant' THEN 'Restaurant' WHEN 'pub' THEN 'Pub' WHEN 'biergarten' THEN 'Beer garden' WHEN 'fuel' THEN 'Fuel' ELSE CASE WHEN tourism IS NOT NULL THEN 'Mountain hut' ELSE 'Stop' END END AS kind FROM p""")
def stop_kinds(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", f"{KINDS_SQL} AS amenity", "CASE WHEN p_size % 9 = 6 THEN 'alpine_hut' END AS tourism")
    tags = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("amenity", "tourism"))), lambda e: e.v.isNotNull()))
    return p.select("id", listing.stop_kind(tags).alias("s")).select("id", "s.*")


# ---------------------------------------------------------------- views

@query(
    f"""WITH e AS ({EVENT_LINE}), n AS (SELECT road, max(k) AS n FROM e GROUP BY road), q AS (SELECT road, n, m, least(n * 10, greatest(0, m * 13 - 20))::DOUBLE AS x, m * 13 - 20 AS want FROM n, range(0, 60) r(m))
SELECT q.road, q.want::DOUBLE AS x, round(a.value + coalesce(b.value - a.value, 0) * (q.x / 10 - a.k), 6) AS value FROM q JOIN e a ON a.road = q.road AND a.k = floor(q.x / 10) LEFT JOIN e b ON b.road = q.road AND b.k = a.k + 1"""
)
def interpolated(spark, sf_dir):
    """Values along each user's events, ten metres apart, at places thirteen apart and beyond the ends."""
    e = spark.sql(EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    line = e.select("road", (F.col("k") * 10.0).alias("x"), "value")
    places = e.select("road").distinct().select("road", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("m")).select("road", (F.col("m") * 13.0 - 20).alias("x"))
    return rounded(views.interpolate(line, places, ["value"]))


def _at(x: str) -> str:
    """Value at x metres of an event line e with n points, ten metres apart."""
    return f"(SELECT a.value + coalesce(b.value - a.value, 0) * ({x} / 10 - a.k) FROM e a LEFT JOIN e b ON b.road = a.road AND b.k = a.k + 1 WHERE a.road = q.road AND a.k = floor({x} / 10))"


@query(
    f"""WITH e AS ({EVENT_LINE}), n AS (SELECT road, max(k) * 10.0::DOUBLE AS total FROM e GROUP BY road HAVING max(k) > 0),
g AS (SELECT road, total, greatest(2, floor(total / greatest(200, least(1000, total / 60)) + 0.5))::BIGINT AS n FROM n), q AS (SELECT road, band, total * band / n AS from_m, total * (band + 1) / n AS to_m, greatest(0, total * (band - 1) / n) AS lo, least(total, total * (band + 2) / n) AS hi FROM g, range(0, 70) r(band) WHERE band < n),
v AS (SELECT road, band, from_m, to_m, ({_at('q.hi')} - {_at('q.lo')}) / (hi - lo) AS grade FROM q)
SELECT road, band, round(from_m, 9) AS from_m, round(to_m, 9) AS to_m, round(grade, 9) AS grade, 1 + (abs(grade) >= 0.04)::INT + (abs(grade) >= 0.07)::INT + (abs(grade) >= 0.1)::INT::BIGINT AS colour FROM v"""
)
def grade_bands(spark, sf_dir):
    """A profile's bands with their grades and colours."""
    e = spark.sql(EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    line = e.select("road", (F.col("k") * 10.0).alias("x"), F.col("value").alias("ele"))
    many = line.groupBy("road").agg(F.count("*").alias("n")).where("n > 1").select("road")
    return rounded(views.profile_bands(line.join(many, "road")), 9)


@query(
    f"""WITH e AS ({EVENT_LINE}), n AS (SELECT road, max(k) * 10.0::DOUBLE AS total FROM e GROUP BY road), q AS (SELECT road, total, m * 37.0::DOUBLE AS d, greatest(0, m * 37 - 150)::DOUBLE AS lo, least(total, m * 37 + 150)::DOUBLE AS hi FROM n, range(0, 25) r(m) WHERE m * 37 <= total)
SELECT road, d AS x, round(CASE WHEN hi > lo THEN ({_at('q.hi')} - {_at('q.lo')}) / (hi - lo) ELSE 0 END, 9) AS grade FROM q"""
)
def grades(spark, sf_dir):
    """The grade at places along each profile, over 150 m either way."""
    e = spark.sql(EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    line = e.select("road", (F.col("k") * 10.0).alias("x"), F.col("value").alias("ele"))
    places = line.groupBy("road").agg(F.max("x").alias("total")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(24)))).where("m * 37 <= total").select("road", (F.col("m") * 37.0).alias("x"))
    return rounded(views.grades(line, places), 9)


@query(
    f"""WITH {CLASSES_SQL}, v AS (SELECT *, lead(k) OVER w AS nk, row_number() OVER w - 1 AS i FROM c WINDOW w AS (PARTITION BY road ORDER BY k)), t AS (SELECT *, k - row_number() OVER (PARTITION BY road, cls ORDER BY k) AS g FROM v WHERE nk IS NOT NULL)
SELECT road, cls::BIGINT AS cls, min(k) AS a, max(nk) AS b, count(*) + 1 AS points FROM t GROUP BY road, cls, g"""
)
def bend_lines(spark, sf_dir):
    """The lines of a road's bends, class by class, joined where they meet. A vertex' number stands for its place."""
    line = sampling.bend_classes(view(spark, sf_dir, PATH)).select("road", "k", F.col("k").cast("double").alias("lon"), F.lit(0.0).alias("lat"), "cls")
    p = F.col("points.lon")
    return views.bend_lines(line).select(
        "road", F.col("cls").cast("long").alias("cls"), F.array_min(p).cast("long").alias("a"), F.array_max(p).cast("long").alias("b"),
        F.size(p).cast("long").alias("points")
    )


@query(
    f"""WITH e AS ({EVENT_LINE}), h AS (SELECT road, max(k) * 10.0::DOUBLE AS total, unnest([15.0, 40.0, 33.0])::DOUBLE AS a, unnest([30.0, 47.0, 1000.0])::DOUBLE AS b FROM e GROUP BY road), q AS (SELECT *, least(total, a) AS lo, least(total, b) AS hi FROM h)
SELECT road, a AS from_m, b AS to_m, round({_at('q.lo')}, 6) AS first, round({_at('q.hi')}, 6) AS last, 2 + (SELECT count(*) FROM e WHERE e.road = q.road AND e.k * 10 > q.a AND e.k * 10 < q.b) AS points FROM q"""
)
def stretch_lines(spark, sf_dir):
    """Stretches of each line, with ends between its vertices; values stand for its longitudes."""
    e = spark.sql(EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    line = e.select("road", (F.col("k") * 10.0).alias("x"), F.col("value").alias("lon"), F.lit(46.0).alias("lat"))
    parts = e.select("road").distinct().select(
        "road",
        F.inline(F.array(*(F.struct(F.lit(a).alias("from_m"), F.lit(b).alias("to_m")) for a, b in ((15.0, 30.0), (40.0, 47.0), (33.0, 1000.0)))))
    )
    p = F.col("points")
    got = views.stretch_lines(line, parts)
    return got.select(
        "road", "from_m", "to_m", F.round(F.get(p, F.lit(0)).lon, 6).alias("first"), F.round(F.element_at(p, -1).lon, 6).alias("last"),
        F.size(p).cast("long").alias("points")
    )


@query(
    """SELECT '/in/f' || s_suppkey || CASE s_suppkey % 6 WHEN 4 THEN '.txt' WHEN 5 THEN '.GPX' ELSE '.gpx' END AS file, 'f' || s_suppkey || CASE s_suppkey % 6 WHEN 1 THEN '.gpx has no track points' WHEN 2 THEN '.gpx isn''t a valid GPX file' WHEN 3 THEN '.gpx has no track points' ELSE '.txt isn''t a .gpx file' END AS error
FROM supplier WHERE s_suppkey % 6 IN (1, 2, 3, 4)"""
)
def import_errors(spark, sf_dir):
    """What is wrong with files that do not import: other endings, broken XML, too few points, places that are no numbers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 6).alias("c"))
    point = lambda lon: f'<trkpt lat="46" lon="{lon}"></trkpt>'
    inside = F.when(F.col("c") == 1, point(7)).when(F.col("c") == 3, point("x") * 3).otherwise(point(7) + point(8))
    text = F.concat(F.lit('<?xml version="1.0"?><gpx version="1.1"><trk><name>n</name><trkseg>'), inside, F.when(F.col("c") == 2, "</trkseg>").otherwise("</trkseg></trk></gpx>"))
    ending = F.when(F.col("c") == 4, ".txt").when(F.col("c") == 5, ".GPX").otherwise(".gpx")
    return tracks.import_errors(s.select(F.concat(F.lit("/in/f"), "s_suppkey", ending).alias("file"), text.alias("content")))


@query(
    f"""WITH w AS ({WAYS}), n AS (SELECT n0 AS node FROM w UNION SELECT n1 FROM w), p AS (SELECT *, {PASS_TEXT} AS ele, 45 + p_partkey % 31 / 10.0::DOUBLE AS lat, 6 + p_partkey % 37 / 10.0::DOUBLE AS lon FROM part)
SELECT p_partkey AS ord, p_name AS name, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1234 WHEN 3 THEN p_partkey END::BIGINT AS ele, round(lon, 5) AS lon, round(lat, 5) AS lat
FROM p WHERE p_size % 4 <> 0 AND p_partkey * 7 % 20011 IN (SELECT node FROM n) AND lat BETWEEN 45.5 AND 47.3 AND lon BETWEEN 6.4 AND 8.8"""
)
def area_passes(spark, sf_dir):
    """The passes of an area's box: a build's second result."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS ord", "p_partkey * 7 % 20011 AS id", "45 + p_partkey % 31 / 10D AS lat", "6 + p_partkey % 37 / 10D AS lon",
        "CASE WHEN p_size % 4 != 0 THEN p_name END AS name", f"{PASS_TEXT} AS ele"
    )
    ways = view(spark, sf_dir, WAYS).select(F.transform(F.array("n0", "n1"), lambda n: F.concat_ws("/", F.lit("a"), n.cast("string"))).alias("nodes"))
    boxes = spark.createDataFrame([("a", 45.5, 6.4, 47.3, 8.8)], "area string, s double, w double, n double, e double")
    found = build.road_passes(_nodes(p, {"mountain_pass": "yes", "name": F.col("name"), "ele": F.col("ele")}), ways)
    return build.passes_within(found, boxes).drop("area")


@query(
    f"""WITH e AS ({EVENT_LINE}), q AS (SELECT road, max(k) * 10.0::DOUBLE AS total, i FROM e, range(0, 120) r(i) GROUP BY road, i), p AS (SELECT road, i, total * i / 119 AS x, total FROM q),
z AS (SELECT road, i, x, floor(round(x / 10, 9)) AS k FROM p)
SELECT z.road, z.i, round(z.x, 4) AS x, round(a.value + coalesce(b.value - a.value, 0) * (z.x / 10 - a.k), 4) AS ele FROM z JOIN e a ON a.road = z.road AND a.k = z.k LEFT JOIN e b ON b.road = z.road AND b.k = z.k + 1"""
)
def profile_points(spark, sf_dir):
    """A hundred and twenty points of each profile."""
    e = spark.sql(EVENT_LINE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rounded(views.profile_points(e.select("road", (F.col("k") * 10.0).alias("x"), F.col("value").alias("ele"))).select("road", "i", "x", "ele"), 4)


@query(
    f"""WITH q AS ({POINTS}), r AS (SELECT label AS road, lon, lat, row_number() OVER (PARTITION BY label ORDER BY point_id) - 1 AS k FROM q), d AS (SELECT road, point_id, lon + 0.01 AS lon, lat FROM (SELECT *, (label + 1) % 10 AS road FROM q)),
n AS (SELECT d.road, d.point_id, r.k FROM d JOIN r ON r.road = d.road AND r.k % 4 = 0 QUALIFY row_number() OVER (PARTITION BY d.road, d.point_id ORDER BY pow(r.lon - d.lon, 2) + pow(r.lat - d.lat, 2), k) = 1)
SELECT road::BIGINT AS road, point_id, (k * 100)::DOUBLE AS x, row_number() OVER (PARTITION BY road ORDER BY k, point_id) AS place FROM n QUALIFY place <= 12"""
)
def stops_along(spark, sf_dir):
    """The first twelve stops along each road."""

    p = view(spark, sf_dir, POINTS)
    line = p.select(
        F.col("label").alias("road"), (F.row_number().over(Window.partitionBy("label").orderBy("point_id")) - 1).alias("k"), "lon", "lat"
    ).withColumn("x", F.col("k") * 100.0)
    return rounded(views.stops_by_km(line, p.select(((F.col("label") + 1) % 10).alias("road"), "point_id", (F.col("lon") + 0.01).alias("p_lon"), F.col("lat").alias("p_lat"))))


def _blend(a: str, b: str, lo: str, hi: str) -> str:
    return f"((({hi}) - t) * ({a}) + (t - ({lo})) * ({b})) / (({hi}) - ({lo}))"


def _curve(c: str) -> str:
    a1, a2, a3 = _blend(f"{c}0", f"{c}1", "0", "t1"), _blend(f"{c}1", f"{c}2", "t1", "t2"), _blend(f"{c}2", f"{c}3", "t2", "t3")
    return _blend(_blend(a1, a2, "0", "t2"), _blend(a2, a3, "t1", "t3"), "t1", "t2")


@query(
    f"""WITH {LINES_SQL}, p AS (SELECT road, j, n, lon, lat, ele, lon * 111320 * cos(radians(first_value(lat) OVER w)) AS x1, lat * 110540 AS y1, 111320 * cos(radians(first_value(lat) OVER w)) AS kx, lead(ele) OVER w AS ele2 FROM lp WINDOW w AS (PARTITION BY road ORDER BY j)),
w4 AS (SELECT *, lead(x1) OVER w AS x2, lead(y1) OVER w AS y2, lag(x1) OVER w AS px, lag(y1) OVER w AS py, lead(x1, 2) OVER w AS nx, lead(y1, 2) OVER w AS ny FROM p WINDOW w AS (PARTITION BY road ORDER BY j)),
f AS (SELECT *, coalesce(px, 2 * x1 - x2) AS x0, coalesce(py, 2 * y1 - y2) AS y0, coalesce(nx, 2 * x2 - x1) AS x3, coalesce(ny, 2 * y2 - y1) AS y3 FROM w4 WHERE x2 IS NOT NULL),
g AS (SELECT *, greatest({span('x1 - x0', 'y1 - y0')}, 1e-6) AS d01, greatest({span('x2 - x1', 'y2 - y1')}, 1e-6) AS d12, greatest({span('x3 - x2', 'y3 - y2')}, 1e-6) AS d23 FROM f),
h AS (SELECT *, sqrt(d01) AS t1, sqrt(d01) + sqrt(d12) AS t2, sqrt(d01) + sqrt(d12) + sqrt(d23) AS t3, greatest(1, ceil(d12 / 3000))::BIGINT AS steps FROM g),
i AS (SELECT *, unnest(range(0, steps)) AS s FROM h), u AS (SELECT *, t1 + (t2 - t1) * s / steps AS t FROM i),
a AS (SELECT road, j, s, {_curve('x')} / kx AS lon, {_curve('y')} / 110540 AS lat, ele + (ele2 - ele) * s / steps AS ele FROM u UNION ALL SELECT road, j, 0, lon, lat, ele FROM w4 WHERE x2 IS NULL)
SELECT road, row_number() OVER (PARTITION BY road ORDER BY j, s) - 1 AS k, round(lon, 6) AS lon, round(lat, 6) AS lat, round(ele, 4) AS ele FROM a"""
)
def smooth_paths(spark, sf_dir):
    """A smooth line through each line's vertices, a point every three kilometres or so."""
    c = _lines(spark, sf_dir).select("road", F.posexplode("coords").alias("j", "p")).select("road", "j", "p.*")
    got = views.smooth_path(c, 3000.0)
    return got.select("road", F.col("k").cast("long").alias("k"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("ele", 4).alias("ele"))


@query(
    """SELECT o_orderkey AS id, least(8000.0::DOUBLE, greatest(0, CASE WHEN o_orderkey % 2 = 1 THEN 8000 - d * 1.25 ELSE d * 1.25 END))::DOUBLE AS at_m, CASE WHEN o_orderkey % 2 = 1 THEN 8000 - (d + 1000) * 1.25 ELSE d * 1.25 END::DOUBLE AS from_m, CASE WHEN o_orderkey % 2 = 1 THEN 'B' ELSE 'A' END AS town
FROM (SELECT o_orderkey, (o_orderkey % 5000)::DOUBLE AS d FROM orders)"""
)
def places_in_view(spark, sf_dir):
    """Stored distances as distances in view, forwards and reversed."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey AS id", "cast(o_orderkey % 5000 AS double) AS d", "o_orderkey % 2 = 1 AS back", "'A' AS `from`", "'B' AS `to`", "1 AS climb",
        "2 AS descent", "array(1, 2) AS coords"
    )
    o = views.directed(o, F.col("back"))
    six, eight = F.lit(6400.0), F.lit(8000.0)
    return o.select(
        "id", views.to_view(F.col("d"), six, eight, F.col("back")).alias("at_m"),
        views.span_in_view(F.col("d"), F.col("d") + 1000, six, eight, F.col("back")).from_m.alias("from_m"), F.col("from").alias("town")
    )


# ---------------------------------------------------------------- texts

CLOSED_SQL = "CASE p_partkey % 8 WHEN 0 THEN 'week 46-20' WHEN 1 THEN 'nov - may' WHEN 2 THEN 'Winter closure' WHEN 3 THEN 'snow' WHEN 4 THEN 'seasonal' WHEN 5 THEN 'WEEK ' || p_size || '-52' WHEN 6 THEN '' END"


@query(
    f"""WITH p AS (SELECT p_partkey AS id, {CLOSED_SQL} AS c, p_size FROM part), m AS (SELECT ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'] AS m)
SELECT id, CASE WHEN c = 'week 46-20' THEN 'Closed about Nov to May' WHEN c = 'nov - may' THEN 'Closed Nov to May' WHEN c LIKE 'Winter%' THEN 'Closed in winter' WHEN c = 'snow' THEN 'Closed when snowy' WHEN c = 'seasonal' THEN 'Seasonal closures'
  WHEN c LIKE 'WEEK%' THEN 'Closed about ' || m[least(11, floor((p_size - 1) * 7 / 30.5))::INT + 1] || ' to Dec' END AS said FROM p, m"""
)
def closures_said(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", f"{CLOSED_SQL} AS c")
    return p.select("id", texts.closure_text(F.col("c")).alias("said"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 40 + p_size / 7.0::DOUBLE AS lat, p_partkey % 90 / 8.0::DOUBLE AS lon, p_size * 2 AS km, p_partkey % 101 / 100.0::DOUBLE AS taste, p_size % 3 AS a, p_partkey % 3 AS b, p_partkey % 2 AS c FROM part)
SELECT id, round(lat - km / 111.32::DOUBLE, 6) AS south, round(lon + km / (111.32::DOUBLE * cos(radians(lat))), 6) AS east, round(lat + km / 111.32::DOUBLE + 0.5 * km / 111.32::DOUBLE, 6)::DOUBLE AS grown, printf('%.3f,%.3f,', lat, lon) || km AS key, CASE WHEN km > 60 THEN 1000 WHEN km > 30 THEN 700 ELSE 400 END::BIGINT AS roads,
  CASE WHEN taste < 0.35::DOUBLE THEN 'Fast sweepers' WHEN taste > 0.65::DOUBLE THEN 'Tight hairpins' ELSE 'A bit of everything' END AS label,
  CASE WHEN a = 1 AND b = 1 AND c = 1 THEN 'terrain, scenery and hairpins as designed' ELSE concat_ws(', ', CASE a WHEN 0 THEN 'terrain less' WHEN 2 THEN 'terrain more' END, CASE b WHEN 0 THEN 'scenery less' WHEN 2 THEN 'scenery more' END, CASE c WHEN 0 THEN 'hairpins less' END) END AS mix,
  CASE b WHEN 0 THEN 'A → B' WHEN 1 THEN 'A' ELSE '' END AS route, CASE WHEN km * 10 / 3.0 < 1.5 * pow(10, floor(log10(km * 10 / 3.0))) THEN 1 WHEN km * 10 / 3.0 < 3 * pow(10, floor(log10(km * 10 / 3.0))) THEN 2 WHEN km * 10 / 3.0 < 7 * pow(10, floor(log10(km * 10 / 3.0))) THEN 5 ELSE 10 END * pow(10, floor(log10(km * 10 / 3.0))) AS step,
  CASE a WHEN 0 THEN '#road=r1' WHEN 1 THEN '#road=r1' ELSE '#scan=46.000,7.000,30&road=r1' END AS link, CASE WHEN a = 2 THEN 46.0 END::DOUBLE AS scan_lat, printf('%.1f', km * 100 / 1000.0) AS kms, printf('%.5f,%.5f', lat, lon) AS point FROM p"""
)
def road_texts(spark, sf_dir):
    """Boxes, keys, limits, labels, routes, steps and links."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS id", "40 + p_size / 7D AS lat", "p_partkey % 90 / 8D AS lon", "p_size * 2 AS km", "p_partkey % 101 / 100D AS taste",
        "p_size % 3 AS a", "p_partkey % 3 AS b", "p_partkey % 2 AS c"
    )
    c = F.col
    box = texts.scan_box(c("lat"), c("lon"), c("km"))
    link = texts.link(F.lit("r1"), F.when(c("a") == 1, "t:46_7").when(c("a") == 2, "46.000,7.000,30"))
    out = p.withColumns({"box": box, "link": link})
    return rounded(out.select(
        "id", F.col("box.s").alias("south"), F.col("box.e").alias("east"), texts.grown_box(F.col("box"), 0.25).n.alias("grown"), texts.scan_key(c("lat"), c("lon"), c("km")).alias("key"), texts.scan_roads(c("km")).alias("roads"), texts.taste_label(c("taste")).alias("label"),
        texts.describe_mix(c("a"), c("b"), c("c")).alias("mix"), texts.route(
            F.when(c("b") < 2, "A").otherwise(""), F.when(c("b") == 0, "B")
        ).alias("route"), texts.nice_step(c("km") * 10, F.lit(3)).alias("step"), "link", texts.linked_scan(F.col("link")).lat.alias("scan_lat"), texts.kilometres(c("km") * 100).alias("kms"), texts.point_text(c("lon"), c("lat")).alias("point"),
    ))


@query(
    f"""WITH a AS (SELECT * FROM ({AREAS})), c AS (SELECT * FROM a WHERE NOT (s >= 45.55::DOUBLE - 1e-6 AND w >= 6.55::DOUBLE - 1e-6 AND n <= 45.95::DOUBLE + 1e-6 AND e <= 7.0::DOUBLE + 1e-6) AND area_ord <> 7)
SELECT 'a' || area_ord AS key, count(point_id) AS roads FROM c LEFT JOIN ({POINTS}) q ON q.point_id % 25 = area_ord GROUP BY area_ord UNION ALL SELECT 'a7', (SELECT count(*) FROM ({POINTS}) WHERE label = 3)"""
)
def merged_areas(spark, sf_dir):
    """Saved scans after a complete one of the key a7 comes in that covers some of them."""
    a = view(spark, sf_dir, AREAS).select(F.concat(F.lit("a"), F.col("area_ord")).alias("key"), "area_ord", F.lit(0).alias("missing"), F.struct("s", "w", "n", "e").alias("box"))
    p = view(spark, sf_dir, POINTS).select(
        F.concat(F.lit("a"), F.col("point_id") % 25).alias("key"), F.col("point_id").alias("road_id"), F.col("point_id").alias("ord"), "kind", "label"
    )
    incoming = {"key": "a7", "area_ord": 99, "missing": 0, "box": (45.55, 6.55, 45.95, 7.0)}
    areas, roads = sets.merge_areas(
        a, p.select("key", "road_id", "ord", F.col("kind").alias("name")), incoming,
        p.where("label = 3").select("road_id", "ord", F.col("kind").alias("name"))
    )
    return areas.select("key").join(roads.groupBy("key").agg(F.count("*").alias("roads")), "key", "left").select("key", F.coalesce("roads", F.lit(0)).cast("long").alias("roads"))


#: Scans that are gone before the next of their key, runs that build on one another, and the members of each key's last run.
RUNS_SQL = f"""sc AS MATERIALIZED (SELECT *, lead(ord) OVER (PARTITION BY key ORDER BY ord) AS nx FROM ({SCANS})),
gone AS (SELECT DISTINCT p.ord FROM sc p JOIN sc c ON c.missing = 0 AND c.ord > p.ord AND (p.nx IS NULL OR c.ord < p.nx) AND c.s <= p.s + 1e-6 AND c.w <= p.w + 1e-6 AND c.n >= p.n - 1e-6 AND c.e >= p.e - 1e-6),
f AS (SELECT *, ord IN (SELECT ord FROM gone) AS out FROM sc), st AS (SELECT *, CASE WHEN missing = 0 OR lag(out) OVER k IS NULL OR lag(out) OVER k THEN ord END AS own FROM f WINDOW k AS (PARTITION BY key ORDER BY ord)),
ru AS (SELECT *, max(own) OVER (PARTITION BY key ORDER BY ord) AS base FROM st), fin AS (SELECT key, ord AS area, base AS from_ord FROM ru WHERE nx IS NULL AND NOT out),
mem AS (SELECT ru.key, ru.ord, fin.area FROM ru JOIN fin ON ru.key = fin.key AND ru.ord >= fin.from_ord)"""


def _scans(spark, sf_dir):
    scans = view(spark, sf_dir, SCANS).select("ord", "key", "missing", F.struct(*(F.col(c).cast("double").alias(c) for c in ("s", "w", "n", "e"))).alias("box"))
    roads = view(spark, sf_dir, SCAN_ROADS)
    passes = roads.select("ord", (F.col("road_id") % 50 / 10).alias("lon"), (F.col("road_id") % 7 / 10).alias("lat"), "pos", "name")
    return sets.merge_scans(scans, roads, sets.first_of(passes, ["ord", "lon", "lat"], "pos"))


@query(
    f"""WITH {RUNS_SQL}, r AS (SELECT mem.key, mem.area, s.* FROM ({SCAN_ROADS}) s JOIN mem ON mem.ord = s.ord),
t AS (SELECT key, area, road_id, arg_min(name, ord) AS name, max(ord) AS late, arg_max(pos, ord) AS pos FROM r GROUP BY key, area, road_id)
SELECT key, road_id, name, row_number() OVER (PARTITION BY key ORDER BY late DESC, pos) AS place FROM t"""
)
def merged_scans(spark, sf_dir):
    """Roads of the areas that are left after all scans came in, in the areas' order."""
    _, roads, _ = _scans(spark, sf_dir)
    return roads.withColumn(
        "place", F.row_number().over(Window.partitionBy("key").orderBy("rank", "pos"))
    ).select("key", "road_id", "name", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {RUNS_SQL}, p AS (SELECT mem.key, s.road_id % 50 AS a, s.road_id % 7 AS b, s.ord, s.pos, s.name FROM ({SCAN_ROADS}) s JOIN mem ON mem.ord = s.ord),
t AS (SELECT key, a, b, arg_min(name, (ord, pos)) AS name FROM p GROUP BY key, a, b)
SELECT fin.key, fin.area AS ord, count(t.key) AS passes, coalesce(max(t.name), '') AS last_name FROM fin LEFT JOIN t ON t.key = fin.key GROUP BY fin.key, fin.area"""
)
def merged_passes(spark, sf_dir):
    """The areas that are left, with how many passes they have, and the last of these by name."""
    areas, _, passes = _scans(spark, sf_dir)
    counted = passes.groupBy("key").agg(F.count("*").alias("passes"), F.max("name").alias("last_name"))
    return areas.join(counted, "key", "left").select(
        "key", F.col("ord").cast("long").alias("ord"), F.coalesce("passes", F.lit(0)).alias("passes"),
        F.coalesce("last_name", F.lit("")).alias("last_name")
    )


@query(
    f"""WITH q AS ({POINTS}), e AS (SELECT point_id, lon, lat, point_id % 2 = 1 AS way, ['primary', 'track', 'trunk', 'unclassified'][point_id % 7 + 1] AS highway FROM q)
SELECT point_id AS id FROM e WHERE CASE WHEN way THEN highway IN ('primary', 'trunk', 'unclassified') AND lon BETWEEN 6.85 AND 7.05 AND (lat BETWEEN 45.9 AND 46.02 OR lat + 0.1::DOUBLE BETWEEN 45.9 AND 46.02)
  ELSE lon BETWEEN 6.85 AND 7.05 AND lat BETWEEN 45.9 AND 46.02 AND (point_id % 5 = 0 OR point_id % 11 = 0) END"""
)
def region_files(spark, sf_dir):
    """Elements of a box, from files laid out along a curve through space, of which those that the box meets are opened."""
    path = shared_dir(spark, "region")
    regions.lay_out(_point_elements(spark, sf_dir), path, 16)
    return regions.read_region(spark, path, 45.9, 6.85, 46.02, 7.05).select("id")

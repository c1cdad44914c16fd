import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from switchback.functions.geo import EARTH_M
from switchback.operators import build, sampling
from switchback.operators.terrain import elevation

ELEMENT = "area string, ord long, type string, id long, nodes array<long>, geometry array<struct<lat: double, lon: double>>, lat double, lon double, tags map<string, string>"
DEG = math.radians(1) * EARTH_M
LAT, LON = 46.0, 7.0


def ground(lon, lat):
    """A slope that rises to the north, 0.08 m a metre, and steeply to the east."""
    return 1000 + (lat - LAT) * DEG * 0.08 + (lon - LON) * DEG * math.cos(math.radians(LAT)) * 0.9


def pixel(lon, lat):
    n = 2**12 * 256
    return (lon + 180) / 360 * n - 0.5, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n - 0.5


def tile(x, y):
    out = []
    for row in range(256):
        lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y * 256 + row + 0.5) / (2**12 * 256)))))
        out += [float(ground((x * 256 + col + 0.5) / (2**12 * 256) * 360 - 180, lat)) for col in range(256)]
    return out


@pytest.fixture(scope="module")
def terrain(spark):
    x0, y0 = pixel(LON - 0.03, LAT + 0.15)
    x1, y1 = pixel(LON + 0.05, LAT - 0.05)
    tiles = [(x, y, tile(x, y)) for x in range(int(x0) >> 8, (int(x1) >> 8) + 1) for y in range(int(y0) >> 8, (int(y1) >> 8) + 1)]
    return spark.createDataFrame(tiles, "x int, y int, metres array<float>").repartition(4).cache()


def wiggle(n, step=10.0, radius=50.0):
    """A road of half circles to either side, northwards: (lon, lat)."""
    pts, x, y, heading, turn = [], 0.0, 0.0, math.pi / 2, 1.0
    per = int(math.pi * radius / step)
    for k in range(n):
        pts.append((LON + x / (DEG * math.cos(math.radians(LAT))), LAT + y / DEG))
        if k % per == 0:
            turn, heading = -turn, math.pi / 2 - (-turn) * math.pi / 2
        x, y, heading = x + step * math.cos(heading), y + step * math.sin(heading), heading + turn * step / radius
    return pts


def way(ord_, id_, nodes, pts, area="a", **tags):
    return Row(area, ord_, "way", id_, nodes, [Row(p[1], p[0]) for p in pts], None, None, {k.replace("__", ":"): v for k, v in tags.items()})


def node(ord_, id_, lon, lat, area="a", **tags):
    return Row(area, ord_, "node", id_, None, None, lat, lon, tags)


def mountain():
    pts = wiggle(800)
    a, b, c = pts[:301], pts[300:601], pts[600:]
    ids = lambda lo, n: list(range(lo, lo + n))
    return pts, [
        way(0, 11, ids(1000, 301), a, name="Lower road", ref="D 17", narrow="yes"),
        way(1, 12, ids(1300, 301)[::-1], b[::-1], name="Upper road", ref="D 17", toll="yes"),
        way(2, 13, ids(1600, 200), c, name="Upper road", ref="D 17", motor_vehicle__conditional="no @ (Nov-May)", maxspeed="FR:urban"),
        way(3, 14, ids(5000, 30), [(LON + 0.02, LAT + k * 0.0001) for k in range(30)], name="Straight"),
        way(4, 15, ids(1000, 301), a, surface="gravel"),
        node(5, 1799, *pts[799], mountain_pass="yes", name="High pass", ele="1450,5 m"),
        node(6, 1400, *pts[400], mountain_pass="yes", name="Low pass", ele="900"),
        node(7, 99, *pts[799], mountain_pass="yes", name="A hiking col", ele="9999"),
        node(8, 98, pts[0][0] + 0.03, pts[0][1], place="village", name="Valley"),
        node(9, 97, pts[0][0] + 0.029, pts[0][1], place="hamlet", name="Nearer"),
        node(10, 96, *pts[400], tourism="viewpoint"),
    ]


def test_a_mountain_of_one_road(spark, terrain):
    pts, rows = mountain()
    elements = spark.createDataFrame([*rows, *(r.__class__("b", *r[1:]) for r in rows)], ELEMENT)
    got = {r.area: r for r in build.find_roads(elements, terrain).collect()}
    assert got.keys() == {"a", "b"} and got["a"][1:] == got["b"][1:]  # areas do not meet
    r = got["a"]
    length = 10 * 799
    assert abs(r.len - length) < 150 and r.place == 1
    assert (r.name, r.road_text, r.ref) == ("High pass", "D 17 · Upper road", "D 17")
    assert r["pass"].name == "High pass" and r["pass"].ele == 1451
    assert (r["from"], r.to) == ("Nearer", None)  # the nearest place to either end, said once
    assert r.climb > r.descent and r.coords[0].lat < r.coords[-1].lat and r.coords[0].ele < r.coords[-1].ele
    assert r.warn.toll and r.warn.closed == "Nov-May" and abs(r.warn.narrow - 37) <= 2 and r.warn.tunnel == 0
    assert abs(sum(r.bends) - r.len / 1000) < 0.6 and r.bends[2] > 0.8 * sum(r.bends)  # a radius of 50 m is class 3, gentler where the sides change
    assert r.hairpins == 0 and 0 < r.score <= 100  # at a radius of 50 m, 120 m turn by no more than 138 degrees
    n = len(r.slices)
    assert n == math.ceil(r.len / 200) and abs(sum(s.c3 for s in r.slices) - 100 * r.bends[2]) <= 1
    assert sum(s.u for s in r.slices) == pytest.approx(200, abs=8)  # the urban way, of 2 km
    assert sum(s.x for s in r.slices) >= 1 and sum(s.p == 9 for s in r.slices) > n / 3  # where the road runs along the slope
    assert r.id.startswith("r") and r.ele_min < r.ele_max
    for c in r.coords:
        assert abs(c.ele - ground(c.lon, c.lat)) < 45  # smoothed over the wiggles


def test_every_section_is_described_and_ranked(spark, terrain):
    # 645 roads through a town, and one with fewer bends that is more fun than any of them
    line, n = wiggle(290), 645
    roads = [way(k, 10_000 + k, [k * 1000 + i for i in range(290)], line, name=f"Town {k}", maxspeed="FR:urban") for k in range(n)]
    best = way(n, 20_000, [n * 1000 + i for i in range(270)], line[:270], name="Best")
    got = {r.name: r for r in build.find_roads(spark.createDataFrame([*roads, best], ELEMENT), terrain).select("name", "place", "score", "len").collect()}
    assert len(got) == n + 1 and got["Best"].place == 1
    assert got["Best"].score > got["Town 0"].score and got["Best"].len < got["Town 0"].len
    assert [got[f"Town {k}"].place for k in range(n)] == list(range(2, n + 2))  # equal ones in order


def test_places_by_score_curvy_and_section(spark):
    rows = [("a", "s1", 50, 1.0), ("a", "s2", 60, 0.5), ("a", "s3", 50, 2.0), ("a", "s0", 50, 1.0 + 1e-12), ("b", "s9", 1, 1.0)]
    got = build.ranked(spark.createDataFrame(rows, "area string, section string, score long, curvy double")).collect()
    assert {(r.area, r.section): r.place for r in got} == {("a", "s2"): 1, ("a", "s3"): 2, ("a", "s0"): 3, ("a", "s1"): 4, ("b", "s9"): 1}


def test_lines_are_kept_of_roads_with_candidates_only(spark, terrain, monkeypatch):
    kept, write = {}, build.stored
    monkeypatch.setattr(build, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    straight = [way(20 + n, 200 + n, list(range(9000 + 500 * n, 9400 + 500 * n)), [(LON + 0.001 * n, LAT + k * 0.0001) for k in range(400)], name="Straight") for n in range(5)]
    build.find_roads(spark.createDataFrame([*mountain()[1], *straight], ELEMENT), terrain)
    of = lambda name: {r.road for r in kept[name].select("road").distinct().collect()}
    assert of("vertices") == of("samples") == {r.chain for r in kept["candidates"].collect()} == {"a/000000000000"}
    assert "ways" not in kept  # no second copy of all geometries


def test_candidates_are_sections_with_the_bends_before_their_end(spark):
    at = {5: 1, 6: 2, 405: 4, 900: 3, 909: 1}
    rows = [(f"a/{n}", k, at.get(k, 0)) for n, last in ((1, 909), (2, 950)) for k in range(last + 1)] + [("a/3", 0, 4)]
    samples = spark.createDataFrame(rows, "road string, k long, cls int")
    got = {(r.chain, r.a, r.b, *(round(r[f"km{c}"], 6) for c in range(1, 5)), r.length) for r in build.candidates(samples, None, 0, 0, 0).collect()}
    assert got == {
        ("a/1", 0, 420, 0.01, 0.01, 0, 0.01, 4200.0), ("a/1", 885, 909, 0, 0, 0.01, 0, 240.0),
        ("a/2", 0, 420, 0.01, 0.01, 0, 0.01, 4200.0), ("a/2", 885, 924, 0.01, 0, 0.01, 0, 390.0)
    }


def test_what_is_no_road(spark, terrain):
    elements = spark.createDataFrame([r for r in mountain()[1] if r[1] in (3, 4, 8)], ELEMENT)
    assert build.find_roads(elements, terrain).collect() == []
    assert build.find_roads(elements.limit(0), terrain).collect() == []


def test_elevation_is_exact_on_a_slope_and_needs_its_tiles(spark, terrain):
    places = [(i, LON + i * 0.0007, LAT + i * 0.0009) for i in range(60)]
    got = {r.i: r.ele for r in elevation(spark.createDataFrame(places, "i long, lon double, lat double"), terrain).collect()}
    assert all(got[i] == pytest.approx(ground(lon, lat), abs=0.05) for i, lon, lat in places)
    with pytest.raises(Exception, match="no terrain tile"):
        elevation(spark.createDataFrame([(1, 100.0, 10.0)], "i long, lon double, lat double"), terrain).collect()


def test_points_given_twice_have_the_same_elevation(spark, terrain):
    twice = spark.createDataFrame([(1, LON + 0.001, LAT + 0.001)] * 2, "i long, lon double, lat double")
    assert [r.ele for r in elevation(twice, terrain).collect()] == [pytest.approx(ground(LON + 0.001, LAT + 0.001), abs=0.05)] * 2


def test_ends_of_a_line(spark):
    line = [Row(46.0, 7.0), Row(46.0, 7.1), Row(46.0, 7.2), Row(46.1, 7.2), Row(46.2, 7.2)]
    df = spark.createDataFrame([(line,), (line[:2],), (line[:1] * 2,)], "g array<struct<lat: double, lon: double>>")
    got = df.select(build.end_direction(F.col("g"), True).alias("s"), build.end_direction(F.col("g"), False).alias("e")).collect()
    size = math.hypot(0.2 * math.cos(math.radians(46)), 0.1)
    assert got[0].s.dx == pytest.approx(-0.2 * math.cos(math.radians(46)) / size) and got[0].s.dy == pytest.approx(-0.1 / size)
    assert got[1].s.dx == pytest.approx(-1) and got[1].e.dx == pytest.approx(1) and tuple(got[2].s) == (0, 0)


def test_owner_of_a_distance(spark):
    v = spark.createDataFrame([("r", 0.0, "a"), ("r", 10.0, "b"), ("r", 20.0, "c")], "road string, d double, way string")
    q = spark.createDataFrame([("r", d, n) for n, d in enumerate((0.0, 0.1, 10.0, 10.1, 20.0, 25.0))], "road string, d double, n int")
    assert [r.way for r in build.owners(v, q).orderBy("n").collect()] == ["a", "b", "b", "c", "c", "c"]


def test_samples_on_a_vertex_belong_to_it(spark):
    p = spark.createDataFrame([("r", i, 10.0 * i, 0.0) for i in range(4)], "road string, i long, x double, y double")
    assert [(r.k, r.owner) for r in sampling.resample(p).orderBy("k").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_pass_elevations(spark):
    texts = {"1 234": 1.0, "1234,5 m": 1234.5, "": None, "x": None, None: None, "2034": 2034.0, "-3.5": -3.5}
    df = spark.createDataFrame(list(texts.items()), "t string, want double")
    assert all(r.got == r.want for r in df.select("want", build.pass_metres(F.col("t")).alias("got")).collect())
    assert [r[0] for r in spark.createDataFrame([("12.7 m",), ("m",)], "t string").select(build.whole_metres(F.col("t"))).collect()] == [12, None]

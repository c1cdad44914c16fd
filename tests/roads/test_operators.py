import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.functions import scoring, tags
from switchback.operators import chains, sampling, sets, spatial, stretches
from switchback.sources import elements, terrain, tracks
from switchback.streaming.rides import append_to, ridden_cells


def slices(spark, road, n=30, c1=20, u=0, ele=lambda i, n: 500 + 500 * (i + 0.5) / n):
    rows = [(road, i, c1, 0, 0, 0, 0, 0, 0.0, 0.0, u / 20, 0, float(ele(i, n)), 46.0) for i in range(n)]
    return spark.createDataFrame(rows, "road string, i long, c1 int, c2 int, c3 int, c4 int, h int, r int, v double, p double, u double, x int, ele double, lat double")


def path(spark, points, road="r"):
    return spark.createDataFrame([(road, k, float(x), float(y)) for k, (x, y) in enumerate(points)], "road string, k long, x double, y double")


def test_a_road_of_sweepers(spark):
    r = stretches.score_roads(slices(spark, "D 17")).first()
    assert (r.score, round(r.linear, 4), round(r.good_km, 6), round(r.terrain, 5)) == (34, 34.2089, 6.0, 1.16111)
    assert r.start == 0 and r.scenery == 1 and r.hairpins == 1


@pytest.mark.parametrize(
    ("n", "u", "road", "want"),
    [
        (30, 0, {"ref": "D 17"}, 53), (24, 0, {"ref": "D 17"}, None), (30, 20, {"ref": "D 17"}, None), (30, 0, {"ref": None}, None),
        (30, 0, {"ref": None, "pass_name": "Col"}, 53), (30, 0, {"ref": "D 17", "narrow": 20}, None), (30, 0, {"has_ref": False, "name": "D 17"}, 53),
        (30, 0, {"has_ref": False, "road_text": "D 17"}, 53), (30, 0, {"has_ref": False, "name": "Rue"}, None)
    ]
)
def test_best_bit_conditions(spark, n, u, road, want):
    full = {"road": "a", "pass_name": None, "has_ref": True, "ref": None, "name": None, "road_text": None, "narrow": None} | road
    roads = spark.createDataFrame([tuple(full.values())], "road string, pass_name string, has_ref boolean, ref string, name string, road_text string, narrow int")
    got = stretches.best_bits(slices(spark, "a", n, u=u), roads).collect()
    assert [r.bit_score for r in got] == ([] if want is None else [want])


def test_scalar_values(spark):
    one = spark.range(1)
    h = [0, 10, 20, 40, 60, 80]
    got = one.select(*(scoring.hairpin_factor(F.lit(float(x)), 1.0).alias(str(x)) for x in h)).first()
    assert [round(x, 6) for x in got] == [1, 1.25, 1.5, 1.707107, 1.866025, 1.866025]
    assert [round(scoring.taste_scale(t), 6) for t in (0, 0.25, 0.5, 0.75, 1)] == [0.684624, 0.836038, 1, 1.066087, 1.121717]
    r = one.select(scoring.road_id(F.lit(7.0), F.lit(46.0), F.lit(7.08), F.lit(46.0)).alias("id")).first().id
    assert int(r[1:], 36) == 1304733113
    b = one.select(F.to_json(scoring.decode_slices(F.lit("k000000000k0000000k0"))).alias("b")).first().b
    assert b == "[[20,0,0,0,0,0,0,0,0,0],[20,0,0,0,0,0,0,0,20,0]]"


@pytest.mark.parametrize(("radius", "cls"), [(300, 0), (150, 1), (80, 2), (50, 3), (20, 4)])
def test_classes_of_circles(spark, radius, cls):
    pts = [(radius * math.cos(10 * k / radius), radius * math.sin(10 * k / radius)) for k in range(30)]
    got = sampling.bend_classes(path(spark, pts)).orderBy("k").collect()
    assert {r.cls for r in got[4:-4]} == {cls} and got[0].cls == got[-1].cls == 0


def test_sections_split_beyond_the_gap(spark):
    for straight, n in ((400, 1), (401, 2)):
        cls = [0] * 100 + [1] + [0] * (straight - 1) + [1] + [0] * 10
        df = spark.createDataFrame([("r", k, c) for k, c in enumerate(cls)], "road string, k long, cls int")
        got = sampling.sections(df).orderBy("a").collect()
        assert len(got) == n and got[0].a == 85 and got[-1].b == len(cls) - 1


def test_hairpins_of_stacked_turns(spark):
    pts, x, y, h = [], 0.0, 0.0, 0.0
    for turn in (1, -1, 1):
        for _ in range(12):
            pts.append((x, y))
            x, y = x + 10 * math.cos(h), y + 10 * math.sin(h)
        for _ in range(4):
            h += turn * math.pi / 4
            pts.append((x, y))
            x, y = x + 10 * math.cos(h), y + 10 * math.sin(h)
    pts += [(x + 10 * k * math.cos(h), y + 10 * k * math.sin(h)) for k in range(12)]
    assert sampling.hairpins(sampling.turning(path(spark, pts))).count() == 3


def test_profiles(spark):
    def profile(e):
        return spark.createDataFrame([("r", k, float(v)) for k, v in enumerate(e)], "road string, k long, ele double")

    assert sampling.crests_and_dips(profile([0, 4.9, 0, 4.9, 0])).collect() == []
    assert [r.at for r in sampling.crests_and_dips(profile([0, 5, 0, 5, 0])).orderBy("at").collect()] == [1, 2, 3]
    ramp = [k * 1.0 for k in range(60)]
    spiked = ramp[:30] + [90.0] + ramp[31:]
    got = [r.ele for r in sampling.smooth_elevation(profile(spiked)).orderBy("k").collect()]
    assert max(abs(a - b) for a, b in list(zip(got, ramp))[15:45]) < 1.5
    assert [r.ele for r in sampling.smooth_elevation(profile([1, 9, 1])).orderBy("k").collect()] == [1, 9, 1]
    c = sampling.climbs(profile([0, 2, 4, 2, 0, -3])).first()
    assert (c.up, c.down, c.grade) == (4, 7, 0)
    g = profile([1, 5, 9, 4]).withColumn("off", F.col("k").isin(1, 3))
    assert [r.ele for r in sampling.filled_ground(g).orderBy("k").collect()] == [1, 5, 9, 9]
    assert [r.ele for r in sampling.filled_ground(g.withColumn("off", F.lit(True))).orderBy("k").collect()] == [1, 5, 9, 4]


def test_steady_bends(spark):
    cls = [0, 1, 0, 0, 2, 2, 0, 0, 3, 3, 0, 0, 0, 2]
    df = spark.createDataFrame([("r", k, c) for k, c in enumerate(cls)], "road string, k long, cls int")
    got = [r.steady for r in sampling.steady_bends(df).orderBy("k").collect()]
    assert got == [0, 0, 0, 0, 2, 2, 3, 3, 3, 3, 0, 0, 0, 2]


def test_simplify_and_resample(spark):
    pts = [(0, 0), (10, 1), (20, 0), (30, 30)]
    assert [r.at for r in sampling.simplified(path(spark, pts)).orderBy("at").collect()] == [0, 2, 3]
    line = path(spark, [(0, 0), (10, 0), (10, 10)]).withColumnRenamed("k", "i")
    assert [(r.x, r.y) for r in sampling.resample(line, 5.0).orderBy("k").collect()] == [(0, 0), (5, 0), (10, 0), (10, 5)]
    assert sampling.resample(line, 5.0, closed=True).count() == 5


WAY = "way long, nodes array<long>, key string, dx0 double, dy0 double, dx1 double, dy1 double"


def test_ways_join_and_rings_are_cut(spark):
    rows = [
        (1, [10, 11, 12], "A", -1.0, 0.0, 1.0, 0.0), (2, [14, 13, 12], "B", 1.0, 0.0, -1.0, 0.0), (3, [14, 15], None, 0.0, 0.0, 0.0, 0.0),
        (7, [20, 21], None, 0.0, 0.0, 0.0, 0.0), (5, [21, 22], None, 0.0, 0.0, 0.0, 0.0), (6, [22, 20], None, 0.0, 0.0, 0.0, 0.0),
        (8, [30, 30], "L", 0.0, 0.0, 0.0, 0.0)
    ]
    ways = spark.createDataFrame(rows, WAY)
    got = sorted(map(tuple, chains.chained(ways.select("way"), chains.pairs(ways)).collect()))
    assert got == [(1, 1, 0, False), (2, 1, 1, True), (3, 1, 2, False), (5, 5, 0, False), (6, 5, 1, False), (7, 5, 2, False), (8, 8, 0, False)]


def test_straightest_pair_at_a_junction(spark):
    rows = [(1, [1, 9], "A", 0.0, 0.0, 1.0, 0.0), (2, [9, 2], "A", -1.0, 0.0, 0.0, 0.0), (3, [9, 3], "A", 0.0, -1.0, 0.0, 0.0), (4, [9, 4], "B", 1.0, 0.0, 0.0, 0.0)]
    got = chains.pairs(spark.createDataFrame(rows, WAY)).collect()
    assert [tuple(r) for r in got] == [(1, False, 2, True)]


def ride(spark, lat, offset, axis, n=201):
    deg = offset / 111320
    coords = spark.createDataFrame([("r", k, 7 + 0.00005 * k, lat) for k in range(201)], "road string, i long, lon double, lat double")
    dx, dy = (deg / math.cos(math.radians(lat)), 0.0) if axis == "lon" else (0.0, deg)
    track = spark.createDataFrame([(7 + 0.00005 * k + dx, lat + dy) for k in range(n)], "p_lon double, p_lat double")
    return spatial.ridden_roads(coords, track).first().ridden


@pytest.mark.parametrize(
    ("lat", "offset", "axis", "n", "want"),
    [
        (46.0, 0, "lat", 201, True), (46.0, 11, "lon", 201, True), (46.0, -34, "lat", 201, True), (46.0, 40, "lat", 201, False),
        (46.0, 0, "lat", 60, False), (80.0, 34, "lat", 201, True), (80.0, 34, "lon", 201, True)
    ]
)
def test_rides(spark, lat, offset, axis, n, want):
    assert ride(spark, lat, offset, axis, n) is want


BOX = "struct<s: double, w: double, n: double, e: double>"


def areas(spark, rows):
    return spark.createDataFrame([(k, o, m, b) for k, o, m, b in rows], f"key string, area_ord long, missing int, box {BOX}")


def test_areas_merge(spark):
    old = areas(spark, [("large", 0, 1, (45.0, 6.0, 47.0, 8.0)), ("outside", 1, 0, (50.0, 1.0, 51.0, 2.0))])
    roads = spark.createDataFrame([("large", "saved", 0, "old text"), ("large", "only-old", 1, "x"), ("outside", "o", 0, "o")], "key string, road_id string, ord long, name string")
    new = spark.createDataFrame([("new", 0, "n"), ("saved", 1, "new text")], "road_id string, ord long, name string")
    a, r = sets.merge_areas(old, roads, {"key": "large", "missing": 1, "box": (45, 6, 47, 8), "area_ord": 2}, new)
    assert sorted(x.key for x in a.collect()) == ["large", "outside"]
    assert sorted((x.road_id, x.name) for x in r.where("key = 'large'").collect()) == [("new", "n"), ("only-old", "x"), ("saved", "old text")]
    a, r = sets.merge_areas(old, roads, {"key": "big", "missing": 0, "box": (44, 5, 48, 9), "area_ord": 2}, new)
    assert sorted(x.key for x in a.collect()) == ["big", "outside"]
    assert sorted(x.road_id for x in r.collect()) == ["new", "o", "saved"]


def test_unknown_coverage_hides_nothing(spark):
    tiles = spark.createDataFrame([("base", 0, "t", 7.0, 46.0)], "road_id string, ord long, name string, lon double, lat double")
    area = spark.createDataFrame([(0, False, (45.0, 6.0, 47.0, 8.0))], f"area_ord int, complete boolean, box {BOX}")
    own = spark.createDataFrame(
        [(0, "legacy", 0, "a", 7.0, 46.0), (0, "base", 1, "other", 7.0, 46.0)],
        "area_ord int, road_id string, ord long, name string, lon double, lat double"
    )
    assert sorted((r.road_id, r.name) for r in sets.collect_roads(tiles, area, own).collect()) == [("base", "t"), ("legacy", "a")]
    assert sorted((r.road_id, r.name) for r in sets.collect_roads(tiles, area.withColumn("complete", F.lit(True)), own).collect()) == [("base", "other"), ("legacy", "a")]


def png(px, colour, kind, palette=None):
    h, w = px.shape[:2]
    bpp = px.shape[2]
    flat, raw = px.reshape(h, w * bpp).astype(int), b""
    for y in range(h):
        row = []
        for x in range(w * bpp):
            a = flat[y, x - bpp] if x >= bpp else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - bpp] if y and x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *row])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    extra = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_kinds_and_terrain_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for colour, bpp in terrain.CHANNELS.items():
        for kind in range(5):
            px = rng.integers(0, 4 if colour == 3 else 256, (5, 7, bpp))
            palette = bytes(range(12)) if colour == 3 else None
            got = terrain.decode_png(png(px, colour, kind, palette))
            want = np.frombuffer(palette, np.uint8).reshape(4, 3)[px[..., 0]] if palette else px[..., :3] if bpp > 2 else px[..., :1].repeat(3, 2)
            assert (got[..., :3] == want).all()
    with pytest.raises(ValueError):
        terrain.decode_png(b"no")
    (tmp_path / "12/3").mkdir(parents=True)
    (tmp_path / "12/3/4.png").write_bytes(png(np.array([[[128, 10, 64]]]), 2, 0))
    r = terrain.read_terrain(spark, str(tmp_path)).first()
    assert (r.z, r.x, r.y, r.metres) == (12, 3, 4, [10.25])


def test_gpx(spark):
    pt = '<trkpt lat="46.0" lon="{}"><ele>1</ele></trkpt>'
    texts = [
        ("a/Ride.GPX", "<gpx><trk><trkseg>" + "".join(pt.format(7 + 0.00007 * k) for k in range(10)) + "</trkseg></trk></gpx>"),
        ("b.gpx", "<gpx><trk><name>N</name><trkseg>" + pt.format(7) + "</trkseg></trk></gpx>"), ("c.gpx", "no xml"),
        ("d.gpx", '<gpx><rte><name>R</name><rtept lat="1" lon="2"/><rtept lat="1" lon="x"/><rtept lat="2" lon="2"/></rte></gpx>')
    ]
    got = {r.file: r for r in tracks.parse_gpx(spark.createDataFrame(texts, "file string, content string")).collect()}
    assert got["a/Ride.GPX"].name == "Ride" and [round((p.lon - 7) / 0.00007) for p in got["a/Ride.GPX"].points] == [0, 4, 8]
    assert got["b.gpx"].points is None and got["c.gpx"].points is None and got["d.gpx"].name == "R" and len(got["d.gpx"].points) == 2


def test_elements_and_tiles(spark, tmp_path):
    (tmp_path / "46_7.json").write_text(
        '[{"type":"way","id":1,"nodes":[1,2],"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3}],"tags":{"highway":"primary"}},{"type":"way","id":2,"nodes":[1],"tags":{}},{"type":"node","id":3,"tags":{"mountain_pass":"yes","place":"village","name":"x"}},{"type":"node","id":4,"tags":{"place":"town"}},{"type":"node","id":5,"tags":{"tourism":"viewpoint"}}]'
    )
    e = elements.read_elements(spark, str(tmp_path), ["46_7"])
    assert [r.kind for r in elements.classified(e).orderBy("id").collect()] == ["way", None, "pass", None, "viewpoint"]
    with pytest.raises(FileNotFoundError):
        elements.read_elements(spark, str(tmp_path), ["46_7", "46_8"])
    roads = spark.createDataFrame([("a", 3, 1), ("b", 3, 2), ("c", 2, 3)], "tile string, version int, ord int")
    elements.write_tiles(roads, str(tmp_path / "tiles"))
    assert [r.ord for r in elements.read_tiles(spark, str(tmp_path / "tiles"), ["a", "c"]).collect()] == [1]


def test_access_rules(spark):
    cases = [
        ({"access": "no"}, False), ({"motorcycle": "yes", "access": "no"}, True), ({"motorcycle": "", "access": "no"}, True),
        ({"vehicle": "private; no"}, False), ({"vehicle": "private;yes"}, True), ({"surface": "gravel"}, False), ({"junction": "circular"}, False),
        ({}, True)
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t map<string, string>")
    assert [r.x for r in df.select("i", tags.rideable(F.col("t")).alias("x")).orderBy("i").collect()] == [w for _, w in cases]


def test_stream_of_points(spark, tmp_path):
    pts = spark.createDataFrame(
        [("2024-01-01 00:10:00", 7.0001, 46.0), ("2024-01-01 00:20:00", 7.0002, 46.0), ("2024-01-01 05:00:00", 8.0, 46.0)],
        "t string, lon double, lat double"
    ).selectExpr("to_timestamp(t) AS ts", "lon", "lat")
    pts.write.parquet(str(tmp_path / "in"))
    cells = ridden_cells(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")))
    append_to(cells, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.points for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_taste_is_learned(spark):
    liked = slices(spark, "a").unionByName(slices(spark, "b", c1=18))
    all_roads = liked.unionByName(slices(spark, "c", c1=2)).unionByName(slices(spark, "d", c1=1))
    ratings = spark.createDataFrame([("a", 1), ("b", 1), ("c", -1), ("d", -1)], "road string, rating int")
    assert tuple(stretches.learn_taste(all_roads, ratings).first()) == (0.5, 1.0, 1.0, 1.0, 4, 4, 2, 2)
    # sweepers against hairpins of like worth: the taste moves as far as it must, and no farther
    tight = slices(spark, "c", c1=0).withColumn("c4", F.lit(10)).unionByName(slices(spark, "d", c1=0).withColumn("c4", F.lit(11)))
    got = stretches.learn_taste(liked.unionByName(tight), ratings).first()
    assert got.agree == 4 and got.taste < 0.5
    assert stretches.learn_taste(all_roads, ratings.where("road != 'a'")).collect() == []

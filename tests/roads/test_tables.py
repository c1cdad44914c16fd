import itertools
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from switchback import storage
from switchback.operators import chains, listing, sets, spatial, tiles
from switchback.sources import elements, keyed, tracks


def test_keyed_tables(spark, tmp_path):
    at, schema = str(tmp_path / "areas"), "key string, v int"
    assert keyed.get_all(spark, at, schema).collect() == []
    keyed.put(spark, at, spark.createDataFrame([("a", 1), ("b", 2)], schema))
    keyed.put(spark, at, spark.createDataFrame([("b", 3), ("c", 4)], schema))
    assert sorted(map(tuple, keyed.get_all(spark, at, schema).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.v for r in keyed.get(spark, at, schema, "b").collect()] == [3]
    before = keyed.current(spark, at)
    broken = spark.createDataFrame([("a", 9)], schema).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        keyed.put(spark, at, broken)
    assert keyed.current(spark, at) == before and keyed.get(spark, at, schema, "a").first().v == 1  # a failed write leaves the old version
    keyed.delete(spark, at, ["a", "x"])
    assert sorted(r.key for r in keyed.get_all(spark, at, schema).collect()) == ["b", "c"]


def test_personal_marks(spark, tmp_path):
    p = tmp_path / "me.json"
    assert keyed.personal(spark, str(p)).collect() == []
    p.write_text('{"id": "r1", "fav": true}\nnot json\n{"id": "r2", "rating": -1}\n')
    assert sorted(map(str, map(tuple, keyed.personal(spark, str(p)).collect()))) == ["('r1', True, None)", "('r2', None, -1)"]


def gpx(*parts):
    return '<?xml version="1.0"?><gpx version="1.1"><metadata><name>Meta</name></metadata>' + "".join(parts) + "</gpx>"


def points(tag, *lonlat):
    return "".join(f'<{tag} lat="{lat}" lon="{lon}"><ele>1</ele></{tag}>' for lon, lat in lonlat)


def test_gpx_files(spark, tmp_path):
    far = [(7.0, 46.0), (7.01, 46.0), (7.0101, 46.0), (7.02, 46.0)]
    route = f"<rte><name>Way</name>{points('rtept', (8.0, 46.0), (8.01, 46.0))}</rte>"
    track = f"<trk><trkseg>{points('trkpt', *far)}</trkseg></trk>"
    for name, text in {
        "A.GPX": gpx(route, track), "b.gpx": gpx(track.replace("<trkseg>", "<name>Ride</name><trkseg>")), "c.gpx": "<gpx", "d.txt": "x",
        "e.gpx": gpx(f"<trk><trkseg>{points('trkpt', (7.0, 46.0))}</trkseg></trk>"), "f.gpx": gpx(track, route)
    }.items():
        (tmp_path / name).write_text(text)
    files = keyed.read_gpx_files(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r for r in tracks.parse_gpx(files).collect()}
    assert got.keys() == {"A.GPX", "b.gpx", "c.gpx", "e.gpx", "f.gpx"}
    lons = lambda f: [p.lon for p in got[f].points]
    assert lons("A.GPX") == [8.0, 8.01, 7.0, 7.01, 7.02]  # the route comes first in the text; 8 m are thinned
    assert lons("b.gpx") == [7.0, 7.01, 7.02] and lons("f.gpx") == [7.0, 7.01, 7.02, 8.0, 8.01]
    assert got["c.gpx"].points is None and got["e.gpx"].points is None
    assert (got["A.GPX"].name, got["b.gpx"].name) == ("Meta", "Ride")


def test_gpx_numbers_are_decimals(spark):
    df = spark.createDataFrame([([(0.00012, -0.0000034, 0.0)],)], "p array<struct<lon: double, lat: double, ele: double>>")
    text = df.select(tracks.to_gpx(F.lit("x"), F.col("p"))).first()[0]
    assert 'lat="-0.0000034" lon="0.00012"' in text and "E-" not in text


def test_nearest_place_far_north(spark):
    p = spark.createDataFrame([(1, 20.0, 70.0), (2, 20.0, 84.0)], "point_id long, lon double, lat double")
    places = spark.createDataFrame([(5, 20.12, 70.0), (6, 20.4, 84.0), (7, 21.0, 84.0)], "place_id long, p_lon double, p_lat double")
    got = {r.point_id: (r.place_id, round(r.metres)) for r in spatial.nearest_place(p, places).collect()}
    assert got == {1: (5, 4564), 2: (6, 4649)}


def test_many_stops_of_one_name(spark):
    stops = spark.range(3000).select(F.col("id").alias("ord"), F.lit("Chain").alias("name"), (F.col("id") * 0.01).alias("lon"), F.lit(46.0).alias("lat"))
    more = stops.select(F.col("ord") + 3000, "name", F.col("lon") + 0.001, "lat").union(stops.select(F.col("ord") + 6000, F.lit(None), "lon", "lat"))
    got = {r.ord for r in sets.without_near_namesakes(stops.union(more)).collect()}
    assert got == {*range(3000), *range(6000, 9000)}


def test_list_arguments(spark):
    roads = spark.createDataFrame([(1, "a", None, 3)], "ord long, id string, pass_name string, score int")
    with pytest.raises(ValueError, match="sort"):
        listing.road_list(roads, "name")
    with pytest.raises(ValueError, match="show"):
        listing.shown(roads, "some")
    areas = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3)], "key string, date long")
    assert [r.key for r in listing.areas_in_order(areas).collect()] == ["y", "x", "z"] and [r.key for r in listing.areas_in_order(areas, True).collect()] == ["z", "x", "y"]


def test_a_step_leaves_its_result_and_nothing_of_other_threads_goes(spark):
    made, other = [], []

    def step():
        made.append(storage.shared_dir(spark, "inner"))
        spark.range(3).write.parquet(made[0])
        thread = threading.Thread(target=lambda: other.append(storage.stored(spark.range(5), "other")))
        thread.start()
        thread.join()
        deeper = storage.kept(spark, "deeper", lambda: storage.stored(spark.range(2), "deepest"))
        return storage.stored(spark.read.parquet(made[0]).union(deeper), "last")

    got = storage.kept(spark, "result", step)
    assert got.count() == 5 and other[0].count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made[0])


def test_a_step_that_fails_leaves_nothing(spark):
    made = []

    def step():
        made.append(storage.shared_dir(spark, "inner"))
        spark.range(3).write.parquet(made[0])
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        storage.kept(spark, "result", step)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made[0])


def test_greedy_pairs_match_plain_loops(spark):
    rng = random.Random(3)
    ways = []
    for i in range(120):
        a, b = rng.randrange(25), rng.randrange(25)
        turn = [rng.uniform(0, 2 * math.pi) for _ in range(2)]
        ways.append((i, [a, *([rng.randrange(100, 130)] if i % 3 else []), b], rng.choice(["A", "B", None]), *(f(t) for t in turn for f in (math.cos, math.sin))))
    ends = {}
    for w, nodes, *_ in ways:
        if nodes[0] != nodes[-1]:
            ends.setdefault(nodes[0], []).append((w, True))
            ends.setdefault(nodes[-1], []).append((w, False))
    inner = {n for _, nodes, *_ in ways for n in nodes[1:-1]}
    want = set()
    for node, es in ends.items():
        if len(es) == 2 and node not in inner and es[0][0] != es[1][0]:
            want.add(frozenset(es))
            continue
        for key in {ways[w][2] for w, _ in es} - {None}:
            free = sorted((e for e in es if ways[e[0]][2] == key), key=lambda e: (e[0], e[1]))
            at = lambda e: ways[e[0]][3:5] if e[1] else ways[e[0]][5:7]
            while True:
                options = [(sum(p * q for p, q in zip(at(u), at(v))), u, v) for u, v in itertools.combinations(free, 2) if u[0] != v[0]]
                if not options:
                    break
                _, u, v = min(options, key=lambda o: o[0])
                want.add(frozenset((u, v)))
                free = [e for e in free if e not in (u, v)]
    df = spark.createDataFrame(ways, "way long, nodes array<long>, key string, dx0 double, dy0 double, dx1 double, dy1 double")
    got = [frozenset(((r.a, r.a_start), (r.b, r.b_start))) for r in chains.pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) > 40


def test_written_elements_and_rebuilt_bits(spark, tmp_path):
    e = spark.createDataFrame(
        [("46_7", 0, "node", 1, 46.1, {"a": "1"}), ("46_7", 5, "node", 1, 46.2, {"a": "2"}), ("46_8", 1, "node", 1, 46.3, None)],
        "tile string, ord long, type string, id long, lat double, tags map<string, string>"
    )
    elements.write_elements(e, str(tmp_path / "e"))
    assert sorted((r.tile, r.lat, r.tags) for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [("46_7", 46.2, {"a": "2"}), ("46_8", 46.3, None)]
    slice_ = (20, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    coords = [(7.0, 46.0, 500.0), (7.08, 46.0, 1000.0)]
    roads = [
        ("46_7", i + 1, f"r{i}", "Road", None, ref, None, None, 6000, 0, 1000, None, (0,), coords, [slice_] * n, 34) for i,
        (ref, n) in enumerate((("D 17", 30), (None, 30), ("D 18", 24)))
    ]
    schema = "area string, pos long, id string, name string, road_text string, ref string, `from` string, `to` string, len long, hairpins int, ele_max int, pass struct<name: string>, warn struct<narrow: int>, coords array<struct<lon: double, lat: double, ele: double>>, slices array<struct<c1: int, c2: int, c3: int, c4: int, h: int, r: int, v: int, p: int, u: int, x: int>>, score int"
    got = tiles.rebuilt_bits(spark.createDataFrame(roads, schema)).collect()
    assert [(r.id, r.bit_score, r.bb.e) for r in got] == [("r0", 53, 7.08)]

import random
import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from switchback.operators import quadtree, sets
from switchback.operators.terrain import elevation, elevation_of, needed_tiles
from switchback.sources import elements, keyed, regions, terrain

EDGES = "w double, s double, e double, n double"


def boxes(rng, n):
    out = []
    for i in range(n):
        w, s, size = rng.uniform(-179, 170), rng.uniform(-89, 80), 10 ** rng.uniform(-4, 1.8)
        out.append((i, w, s, min(180.0, w + size * rng.random()), min(90.0, s + size * rng.random())))
    return out


def test_boxes_that_overlap_or_cover_match_brute_force(spark):
    rng = random.Random(4)
    a = boxes(rng, 300) + [(1000, -180.0, -90.0, 180.0, 90.0), (1001, 5.0, 5.0, 5.0, 5.0), (1002, None, 1.0, 2.0, 3.0), (1003, 0.0, 0.0, 0.0, 40.0)]
    b = boxes(rng, 250) + [(2000, 5.0, 5.0, 6.0, 6.0), (2001, 4.0, None, 6.0, 6.0)]
    left = spark.createDataFrame(a, f"id long, {EDGES}").repartition(3)
    right = spark.createDataFrame(b, "r_id long, r_w double, r_s double, r_e double, r_n double")
    whole = lambda x: None not in x
    meet = lambda x, y: whole(x) and whole(y) and x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2]
    inside = lambda x, y: whole(x) and whole(y) and y[1] <= x[1] + 1e-6 and y[2] <= x[2] + 1e-6 and y[3] >= x[3] - 1e-6 and y[4] >= x[4] - 1e-6
    assert sorted(r.id for r in quadtree.overlapping(left, right).collect()) == [x[0] for x in a if any(meet(x, y) for y in b)]
    assert sorted(r.id for r in quadtree.overlapping(left, right, "r_id % 2 = id % 2").collect()) == [x[0] for x in a if any(meet(x, y) and x[0] % 2 == y[0] % 2 for y in b)]
    assert sorted(r.id for r in quadtree.uncovered(left, right).collect()) == [x[0] for x in a if not any(inside(x, y) for y in b)]
    assert quadtree.uncovered(left, right.limit(0)).count() == len(a) and quadtree.overlapping(left, right.limit(0)).collect() == []


def test_boxes_of_any_size_make_few_rows(spark):
    rows = [(40.0, 0.0, 80.0, 40.0), (-180.0, -90.0, 180.0, 90.0), (7.0, 46.0, 7.0, 46.0), (7.0, 46.0, 7.001, 46.3), (179.9, 89.9, 200.0, 95.0)]
    df = spark.createDataFrame(rows, EDGES)
    cells = quadtree.cover(*(F.col(c) for c in "wsen"))
    sizes = [r.n for r in df.select(F.size(cells).alias("n")).collect()]
    assert max(sizes) <= 64 and min(sizes) >= 1
    assert df.select(F.max(F.size(quadtree.above(quadtree.cover(*(F.col(c) for c in "wsen"), 4))))).first()[0] <= 4 * quadtree.LEVELS + 30


def element_rows():
    rng, rows = random.Random(8), []
    for i in range(3000):
        lat, lon = rng.uniform(40, 50), rng.uniform(0, 20)
        tags = rng.choice([{"highway": "primary"}, {"highway": "track"}, {"mountain_pass": "yes"}, {"place": "town"}, {"place": "hamlet"}, {"tourism": "viewpoint"}, {}, None])
        way = tags is not None and "highway" in tags
        line = [(lat, lon), (lat + rng.uniform(-0.3, 0.3), lon + rng.uniform(-0.3, 0.3))] if way else None
        rows.append(("way" if way else "node", i, None, line, None if way else lat, None if way else lon, tags))
    return rows + [("node", 9999, None, None, None, None, {"place": "city"})]


def test_region_opens_only_files_that_meet_it(spark, tmp_path):
    table = spark.createDataFrame(element_rows(), elements.ELEMENT)
    at = str(tmp_path / "map")
    regions.lay_out(table, at, 40)
    assert spark.read.parquet(f"{at}/elements").count() == 3001
    box = (44.0, 6.0, 44.8, 7.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    got = regions.read_region(spark, at, *box)
    assert got.columns == table.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in elements.requested(table, *box).collect()) != []
    assert 0 < len(got.inputFiles()) < 12 < len(spark.read.parquet(f"{at}/elements").inputFiles())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s)" in plan and "LessThanOrEqual(s,44.8)" in plan
    some = regions.read_region(spark, at, *box, classes=["pass", "town"])
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in elements.requested(table, *box).where("tags['mountain_pass'] = 'yes' OR tags['place'] = 'town'").collect())
    assert "In(class, [pass,town])" in some._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert regions.read_region(spark, at, -10, -10, -9, -9).collect() == [] and regions.read_region(spark, at, *box, classes=[]).collect() == []


def png(value):
    rows = b"".join(b"\0" + bytes([128, value, 0]) * 256 for _ in range(256))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 256, 256, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_terrain_opens_only_tiles_that_points_need(spark, tmp_path, monkeypatch):
    points = spark.createDataFrame([(1, 7.0, 46.0), (2, 7.01, 46.0), (3, 7.3, 46.2)], "id long, lon double, lat double")
    needed = {(r.x, r.y) for r in needed_tiles(points).collect()}
    x0, y0 = min(needed)
    for x in range(x0 - 10, x0 + 15):
        (tmp_path / "12" / str(x)).mkdir(parents=True)
        for y in range(y0 - 20, y0 + 20):
            # what is not needed is no PNG, and would fail if it were decoded
            (tmp_path / "12" / str(x) / f"{y}.png").write_bytes(png(y - y0 + 20) if (x, y) in needed else b"no tile")
    got = terrain.read_terrain(spark, str(tmp_path), needed_tiles(points))
    assert len(got.inputFiles()) == len(needed) == got.count() and terrain.tile_files(spark, str(tmp_path)).count() == 1000
    ele = {r.id: r.ele for r in elevation_of(points, str(tmp_path)).collect()}
    assert ele == {r.id: r.ele for r in elevation(points, got).collect()} and len(ele) == 3
    monkeypatch.setattr(terrain, "MOST_TILES", 1)  # more are needed than are named: all are listed, and still only those decoded
    assert terrain.read_terrain(spark, str(tmp_path), needed_tiles(points)).count() == len(needed)
    assert terrain.read_terrain(spark, str(tmp_path), needed_tiles(points).where("x < 0")).collect() == []


def test_a_key_that_is_there_makes_its_kind(spark):
    rows = [
        ("node", 1, None, None, 46.0, 7.0, {"mountain_pass": "", "place": "town", "name": "A"}),
        ("node", 2, None, None, 46.0, 7.0, {"place": "", "name": "B"}), ("node", 3, None, None, 46.0, 7.0, {"place": "town", "name": ""}),
        ("node", 4, None, None, 46.0, 7.0, None)
    ]
    got = {r.id: r.kind for r in elements.classified(spark.createDataFrame(rows, elements.ELEMENT)).collect()}
    assert got == {1: "pass", 2: "place", 3: None, 4: None}


def merged_by_loop(scans, roads, passes):
    areas = []
    for ord_, key, missing, box in sorted(scans):
        mine = {
            "key": key, "ord": ord_, "missing": missing, "box": box, "roads": {r[1]: r for r in sorted(roads, key=lambda r: r[2]) if r[0] == ord_},
            "passes": {r[1:3]: r for r in sorted(passes, key=lambda r: r[3]) if r[0] == ord_}
        }
        before = next((a for a in areas if a["key"] == key), None)
        if missing != 0 and before:
            for kind in ("roads", "passes"):
                mine[kind] |= before[kind]  # the place of the new one, the text of the known one
        s, w, n, e = box
        covered = lambda a: missing == 0 and s <= a["box"][0] + 1e-6 and w <= a["box"][1] + 1e-6 and n >= a["box"][2] - 1e-6 and e >= a["box"][3] - 1e-6
        areas = [a for a in areas if a["key"] != key and not covered(a)] + [mine]
    return areas


@pytest.mark.parametrize("n", [0, 1000])
def test_all_scans_at_once_equal_one_after_another(spark, n):
    rng, scans, roads, passes = random.Random(11), [], [], []
    for i in range(n):
        s, w, size = rng.uniform(45, 48), rng.uniform(6, 9), 10 ** rng.uniform(-1.5, 0.3)
        scans.append((i, f"k{rng.randrange(60)}", rng.choice([0, 0, 1, 3, None]), (s, w, s + size, w + size)))
        roads += [(i, f"r{k}", j, f"{i}-{k}") for j, k in enumerate(rng.sample(range(40), 4))]
        passes += [(i, float(k), 1.5, j, f"{i}-{k}") for j, k in enumerate(rng.sample(range(20), 2))]
    areas, kept, found = sets.merge_scans(
        spark.createDataFrame(scans, "ord long, key string, missing int, box struct<s: double, w: double, n: double, e: double>").repartition(5),
        spark.createDataFrame(roads, "ord long, road_id string, pos int, name string"), spark.createDataFrame(passes, "ord long, lon double, lat double, pos int, name string"),
    )
    want = merged_by_loop(scans, roads, passes)
    assert [(r.key, r.ord, r.missing, tuple(r.box)) for r in areas.orderBy("ord").collect()] == [(a["key"], a["ord"], a["missing"], a["box"]) for a in want]
    for got, kind, key in ((kept, "roads", 1), (found, "passes", 1)):
        by_key = {}
        for r in got.orderBy("key", "rank", "pos").collect():
            by_key.setdefault(r.key, []).append(r.name)
        assert by_key == {a["key"]: [x[-1] for x in a[kind].values()] for a in want if a[kind]}


def test_no_commit_of_many_writers_is_lost(spark, tmp_path):
    at, schema = str(tmp_path / "areas"), "key string, v int"

    def write(t):
        for i in range(10):
            keyed.put(spark, at, spark.createDataFrame([(f"{t}-{i}", i), ("all", t)], schema))

    with ThreadPoolExecutor(8) as threads:
        list(threads.map(write, range(8)))
    rows = {r.key: r.v for r in keyed.get_all(spark, at, schema).collect()}
    assert rows.pop("all") in range(8) and rows == {f"{t}-{i}": i for t in range(8) for i in range(10)}
    # readers of an earlier version see it, and whole versions change nothing
    last = keyed.current(spark, at)
    keyed.put(spark, at, spark.createDataFrame([("0-0", 77)], schema))
    assert {r.v for r in keyed.get_all(spark, at, schema, last).where("key = '0-0'").collect()} == {0}
    keyed.delete(spark, at, ["0-1"])
    before = sorted(map(tuple, keyed.get_all(spark, at, schema).collect()))
    keyed.compact(spark, at, schema)
    assert sorted(map(tuple, keyed.get_all(spark, at, schema).collect())) == before and len(before) == 80


def test_a_change_of_an_old_version_conflicts_by_key(spark, tmp_path):
    at, schema = str(tmp_path / "areas"), "key string, v int"
    row = lambda *x: spark.createDataFrame([x], schema)
    first = keyed.put(spark, at, row("a", 1))
    keyed.put(spark, at, row("b", 1), since=first)
    keyed.put(spark, at, row("a", 2), since=first)  # another key has changed since, which is no conflict
    with pytest.raises(keyed.Conflict):
        keyed.put(spark, at, row("a", 3), since=first)
    with pytest.raises(keyed.Conflict):
        keyed.delete(spark, at, ["b"], since=first)
    assert sorted(map(tuple, keyed.get_all(spark, at, schema).collect())) == [("a", 2), ("b", 1)]


def test_marks_and_the_learned_taste_are_kept(spark, tmp_path):
    at = str(tmp_path / "marks")
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(lambda i: keyed.toggle_fav(spark, at, "r1"), range(3)))
    keyed.rate(spark, at, "r1", -1)
    keyed.rate(spark, at, "r2", 1)
    assert sorted(map(tuple, keyed.get_all(spark, at, keyed.MARKS).collect())) == [("r1", True, -1), ("r2", False, 1)]
    keyed.rate(spark, at, "r2", 1)
    keyed.toggle_fav(spark, at, "r1")
    assert sorted(map(tuple, keyed.get_all(spark, at, keyed.MARKS).collect())) == [("r1", False, -1)]
    taste = spark.createDataFrame([(0.7, 1.0, 1.5, 0.5, 9, 12, 4, 3)], keyed.TUNED.removeprefix("key string, "))
    assert keyed.tuned(spark, at + "t") is None
    keyed.save_tuned(spark, at + "t", taste)
    assert (keyed.tuned(spark, at + "t").taste, keyed.tuned(spark, at + "t").pairs) == (0.7, 12)
    keyed.save_tuned(spark, at + "t", taste.limit(0))
    assert keyed.tuned(spark, at + "t") is None

import random

from pyspark.sql import functions as F

from switchback.operators import chains, listing, sampling, stretches
from switchback.streaming import tiles

FIELDS = ("name", "road_text", "from", "to", "pass_name")


def test_search_by_index_equals_the_scan(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé DE") for _ in range(rng.randrange(1, 12)))
    rows = [
        (f"r{i}", *(rng.choice([None, "", word(), word() + " " + word()]) for _ in FIELDS)) for i in range(400)
    ] + [("all", "The quick brown fox jumps", None, None, None, None)]
    roads = spark.createDataFrame(rows, ["id", *FIELDS]).cache()
    index = listing.text_index(roads).cache()
    assert index.count() == index.distinct().count()
    words = [rng.choice("abcéDE") for _ in range(3)] + [word() for _ in range(12)] + ["The quick brown fox j", "quick brown fox", "QUICK", "zzz", " a ", "", "fox jumps high"]
    for w in words:
        got = listing.indexed_roads(roads, index, w)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in listing.matching_roads(roads, w).collect()), w
    # what has all pieces of a long word is nearly what has the word
    pieces = sorted({"quick brown"[i : i + 3] for i in range(9)})
    assert index.where(F.col("gram").isin(pieces)).groupBy("id").count().where(F.col("count") == len(pieces)).count() == 1


def test_ends_pair_as_one_after_another(spark):
    rng, rows = random.Random(3), []
    for node in range(120):
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((node, rng.choice("ab"), rng.randrange(12), rng.random() < 0.5, float(rng.randrange(-3, 4)), float(rng.randrange(-3, 4))))
    rows = list({(r[0], r[2], r[3]): r for r in rows}.values())
    want = set()
    for group in {(r[0], r[1]) for r in rows}:
        free = sorted((r[2:] for r in rows if r[:2] == group), key=lambda r: r[:2])
        while options := [(u[2] * v[2] + u[3] * v[3], i, j) for i, u in enumerate(free) for j, v in enumerate(free) if i < j and u[0] != v[0]]:
            _, i, j = min(options)
            want.add((*group, *free[i][:2], *free[j][:2]))
            free = [x for k, x in enumerate(free) if k not in (i, j)]
    ends = spark.createDataFrame(rows, "node long, key string, way long, at_start boolean, dx double, dy double")
    got = chains.straightest(ends).collect()
    assert sorted((r.a, r.a_start, r.b, r.b_start) for r in got) == sorted(w[2:] for w in want)
    assert chains.straightest(ends.limit(0)).collect() == []


def test_index_that_follows_changes_equals_one_built_anew(spark, tmp_path):
    rng, versions, at = random.Random(5), {}, str(tmp_path / "index")
    batches = []
    for n in range(5):
        rows = []
        for t in rng.sample(range(12), 5):
            v = rng.choice([x for x in range(40) if (t, x) not in versions])
            roads = [(f"t{t}", v, p, f"r{t}-{v}-{p}", rng.randrange(100), rng.choice([None, *range(50)])) for p in range(rng.choice([0, 1, 4, 9]))]
            versions[t, v] = roads
            rows += roads or [(f"t{t}", v, None, None, None, None)]
        batches.append(rows)
    schema = "tile string, version long, pos long, id string, score long, bit_score long"
    source = str(tmp_path / "changes")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 4):
            tiles.follow(spark.readStream.schema(schema).parquet(source), at, str(tmp_path / "checkpoint"), most=7).awaitTermination()
    last = {t: max(v for x, v in versions if x == t) for t, _ in versions}
    want = {f"t{t}": versions[t, v] for t, v in last.items()}
    assert {(r.tile, r.version, r.roads, r.ids) for r in tiles.index_of(spark, at).collect()} == {
        (f"t{t}", v, len(versions[t, v]), ",".join(r[3] for r in versions[t, v])) for t, v in last.items()
    }
    best = sorted((r for rows in want.values() for r in rows if r[5] is not None), key=lambda r: (-r[5], -r[4], r[0], r[2]))[:7]
    assert [r.id for r in tiles.bits_of(spark, at, 7).collect()] == [r[3] for r in best]
    some = sorted(want)[:2]
    assert sorted(r.id for r in tiles.roads_of(spark, at, some).collect()) == sorted(r[3] for t in some for r in want[t])
    # a batch that comes again changes no file, and a change of one tile leaves the others' files
    files = lambda: {f.name + str(f.stat().st_mtime_ns) for f in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    tiles.apply_changes(spark.createDataFrame(batches[-1], schema), at, 7)
    assert files() == before
    tiles.apply_changes(spark.createDataFrame([("t0", 99, 0, "new", 1, 49)], schema), at, 7)
    assert len(before - files()) <= 3 and len(files() - before) == 3


def test_all_settings_at_once_equal_one_by_one(spark):
    rng = random.Random(9)
    rows = [
        (
            road, i, rng.randrange(9), rng.randrange(7), rng.randrange(5), rng.randrange(4), rng.randrange(2), rng.randrange(3), rng.random(),
            rng.random(), rng.choice([0.0, 0.6]), rng.randrange(2), 500.0 + rng.randrange(2000), 46.0
        ) for road,
        n in enumerate((1, 5, 74, 75, 76, 200)) for i in range(n)
    ]
    slices = spark.createDataFrame(rows, "road long, i long, c1 int, c2 int, c3 int, c4 int, h int, r int, v double, p double, u double, x int, ele double, lat double")
    settings = [stretches.SETTINGS[k] for k in (0, 13, 148, 200, 296)]
    got = {r.road: r.linear for r in stretches.setting_scores(slices, settings).collect()}
    for k, (taste, mix) in enumerate(settings):
        for r in stretches.score_roads(slices, taste, mix).collect():
            assert abs(got[r.road][k] - r.linear) < 1e-6


def test_long_chords_are_split_by_all_tasks(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for road, n in enumerate((1, 2, 3, 400, 900)):
        x = y = 0.0
        for k in range(n):
            rows.append((road, k, x, y))
            x, y = x + rng.uniform(-5, 10), y + rng.uniform(-8, 8)
    rows += [(9, k, 1.0, 2.0) for k in range(50)]
    samples = spark.createDataFrame(rows, "road long, k int, x double, y double").repartition(6)
    want = sorted(map(tuple, sampling.simplified(samples).collect()))
    for most in (1, 40):
        monkeypatch.setattr(sampling, "UNDER_CHORD", most)
        assert sorted(map(tuple, sampling.simplified(samples).collect())) == want
    assert len(want) > 300 and {r[0] for r in want} == {0, 1, 2, 3, 4, 9}


def test_pieces_of_a_road_are_smoothed_as_the_whole(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for road, n in enumerate((3, 24, 25, 60, 700, 1000)):
        ele = 500.0
        for k in range(n):
            ele += rng.choice([0.0, 1.0, -1.0, 9.0, -9.0, 60.0, -60.0])
            rows.append((road, k, ele))
    # steps that keep two courses apart as long as they go on, so that carries need rounds
    rows += [(7, k, 1e5 if k // 8 % 2 else -1e5) for k in range(600)]
    profile = spark.createDataFrame(rows, "road long, k int, ele double").repartition(5)
    want = {(r.road, r.k): r.ele for r in sampling.smooth_elevation(profile).collect()}
    assert len(want) == len(rows)
    for piece in (64, 100):
        monkeypatch.setattr(sampling, "PIECE", piece)
        got = {(r.road, r.k): r.ele for r in sampling.smooth_elevation(profile).collect()}
        assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-9

import random

from switchback.operators import views


def test_stops_along_a_road_that_winds_at_random(spark, monkeypatch):
    """Each point opens a few cells, however a road's pieces overlap; the nearest vertex is that of a search of all, the first of equals."""
    kept, write = {}, views.stored
    monkeypatch.setattr(views, "stored", lambda df, name: kept.__setitem__(name, write(df, name)) or kept[name])
    rng = random.Random(7)
    spot = lambda: (round(rng.gauss(7, 0.1), 3), round(rng.gauss(46, 0.1), 3))
    line = [(road, k, 100.0 * k, *spot()) for road in (1, 2) for k in range(12_000)] + [(3, k, 100.0 * k, None, None) for k in range(9)]
    points = [(road, n, *spot()) for road in (1, 2) for n in range(60)] + [(1, 60, None, 46.0), (2, 60, 9.5, 46.0), (3, 0, 7.0, 46.0), (4, 0, 7.0, 46.0)]
    got = views.nearest_metres(
        spark.createDataFrame(line, "road long, k long, x double, lon double, lat double"), spark.createDataFrame(points, "road long, point_id long, p_lon double, p_lat double")
    ).collect()
    want = {}
    for road, n, lon, lat in points:
        of = [((v[3] - lon) ** 2 + (v[4] - lat) ** 2 if None not in (v[3], lon) else 0.0, v[1], v[2]) for v in line if v[0] == road and v[1] % 4 == 0]
        if of:
            want[road, n] = min(of)[2]
    assert {(r.road, r.point_id): r.x for r in got} == want and len(got) == len(want)
    assert kept["near"].count() < 20 * len(points)

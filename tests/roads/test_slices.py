import numpy as np

from switchback.functions.scoring import taste_scale, taste_weights
from switchback.operators import stretches
from switchback.plans import adapters


def test_slices_are_dealt_by_road_once_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr(
        "id AS l_orderkey", "id * 7 % 500 AS l_partkey", "id % 40 AS l_suppkey",
        "1 AS l_linenumber", "5D AS l_quantity", "id * 1D AS l_extendedprice", "TIMESTAMP_NTZ '2020-01-01' AS l_shipdate"
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(adapters, "SLICE_ROWS", 100)
    scores = stretches.score_roads(adapters.slices(spark, str(tmp_path)))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "30), REPARTITION_BY_NUM" in plan
    assert sorted((r.road, r.slices) for r in scores.collect()) == [(n, 75) for n in range(40)]


def test_settings_over_equal_stretches_take_the_first_as_if_all_were_rounded(spark):
    """Roads of repeated slices, whose stretches differ in the last bits only, at all settings against rounding every value of every setting."""
    slices = spark.range(3).selectExpr("id AS road", "explode(sequence(0L, 150 + id * 77)) AS i").selectExpr(
        "road", "i", "1 + i % (1 + road) AS c1", "2L AS c2", "i % 2 AS c3", "1L AS c4", "0 AS h", "1 AS r", "1 / 9D AS v", "0.2D AS p", "0D AS u", "0 AS x", "500 + i % 3 * 1D AS ele", "46D AS lat"
    )
    rows = stretches.class_stretches(slices).toPandas().sort_values(["road", "i"])
    got = {r.road: r.linear for r in stretches.setting_scores(slices, stretches.SETTINGS).collect()}
    of = lambda t, c: t[[f"{c}{k}" for k in range(1, 5)]].to_numpy(float)
    for road, table in rows.groupby("road"):
        starts = table[table.s1.notna()]
        for n, (taste, mix) in enumerate(stretches.SETTINGS):
            w, bonus = taste_weights(taste)
            gain = 1 + mix.terrain * starts.terrain + mix.scenery * starts.scene + mix.hairpins * bonus * starts.pins
            fun = np.round((of(starts, "s") @ np.array(w)) * gain.to_numpy(float), 9)
            at = fun.argmax()
            good = (np.round(of(table, "d") @ np.array(w), 9) >= np.round(0.5 * (of(starts, "m")[at] * np.array(w)).sum(), 9)).sum()
            want = 100 * fun[at] / (starts.width.iloc[at] * 0.2) * 15 * np.sqrt(min(good * 0.2, 30) / 15) / (32.2 * taste_scale(taste, mix))
            assert abs(got[road][n] - want) < 1e-7

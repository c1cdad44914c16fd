"""Scores of roads from their 200-metre slices: every window of a road is one frame over one sort of its slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import BIT_KM, GOOD_KM_CAP, NUMBERED, SCORE_REF, SLICE_KM, WINDOW_KM, Mix, alpine, hairpin_factor, js_round, slice_bends, slice_scenery, taste_scale, taste_weights, terrain_parts

COUNTS = ["c1", "c2", "c3", "c4"]


def slice_values(slices: DataFrame, taste: float | None = 0.5, by: tuple[str, ...] = ("road",)) -> DataFrame:
    """slices (road, i, c1..c4, h, r, v and p in 0..1, u in 0..1, x, ele, lat) with bend, hairpins, high (alpine), scenery and nb. Without a taste, slices have the weights w1..w4."""
    weights = [F.col(f"w{k}") for k in range(1, 5)] if taste is None else taste_weights(taste)[0]
    s = slices.withColumns(
        {
            "bend": slice_bends([F.col(c) for c in COUNTS], F.col("u"), weights),
            "hairpins": F.col("h") * F.when(F.col("u") > 0.5, 0.3).otherwise(1.0), "high": alpine(F.col("ele"), F.col("lat"))
        }
    )
    s = s.withColumn("scenery", slice_scenery(F.col("v"), F.col("p"), F.col("x"), F.col("high")))
    return s.withColumn("nb", F.count("*").over(Window.partitionBy(*by)))


def densities(values: DataFrame, by: tuple[str, ...] = ("road",)) -> DataFrame:
    """Adds dens: bends and scenery a km, a mean of five slices, fewer at the ends."""
    near = Window.partitionBy(*by).orderBy("i").rowsBetween(-2, 2)
    return values.withColumn("dens", F.avg(F.col("bend") * (1 + 0.5 * F.col("scenery")) / SLICE_KM).over(near))


def stretches(values: DataFrame, most: int, taste: float | None = 0.5, mix: Mix = Mix(), by: tuple[str, ...] = ("road",)) -> DataFrame:
    """Adds fun and its parts for the stretch of up to ``most`` slices that starts at each slice, where it ends within the road; else fun is null.

    Sums over a stretch are differences of running sums of what is never negative, so a slice is added once however long stretches are; only the relief takes a frame. Without a
    taste, values have the hairpin bonus as a column. values with dens get mean_dens too.
    """
    w = Window.partitionBy(*by).orderBy("i")
    so_far, frame = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, most - 1)
    bonus = F.col("bonus") if taste is None else taste_weights(taste)[1]
    of = {"bends": "bend", "pins": "hairpins", "views": "scenery", "turns": "r", "built": "u"} | ({"mean_dens": "dens"} if "dens" in values.columns else {})
    v = values.withColumns({"width": F.least("nb", F.lit(most)), **{f"run_{n}": F.sum(F.col(c).cast("double")).over(so_far) for n, c in of.items()}})
    # the last row's sums stand for ends beyond it
    ends = F.struct(*(F.col(f"run_{n}").alias(n) for n in of))
    end = F.coalesce(F.lead(ends, most - 1).over(w), F.last(ends).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    v = v.withColumns({"relief": F.max("ele").over(frame) - F.min("ele").over(frame), "end": end})
    v = v.withColumns({n: F.col("end")[n] - F.col(f"run_{n}") + F.col(c) for n, c in of.items()})
    v = v.withColumns({n: F.col(n) / F.col("width") for n in ("built", "mean_dens") if n in of}).drop("end", *(f"run_{n}" for n in of))
    climb, rolling = terrain_parts(F.col("relief"), F.col("turns"), F.col("width") * SLICE_KM)
    v = v.withColumns(
        {
            "rolling": rolling > climb, "terrain": 1 + mix.terrain * 0.5 * F.greatest(climb, rolling),
            "scene": 1 + mix.scenery * 0.5 * F.col("views") / F.col("width"), "pinned": 1 + mix.hairpins * (hairpin_factor(F.col("pins"), bonus) - 1)
        }
    )
    fun = F.round(F.col("bends") * (F.col("terrain") + F.col("scene") + F.col("pinned") - 2), 9)
    return v.withColumn("fun", F.when(F.col("i") + F.col("width") <= F.col("nb"), fun))


def score_roads(slices: DataFrame, taste: float = 0.5, mix: Mix = Mix()) -> DataFrame:
    """A row a road: score, linear, good_km, the parts of its best stretch, its start, peak, and a summary of its scenery.

    The first of equal stretches counts; fun is compared to nine decimals. All frames share one exchange and sort by road.
    """
    most = round(WINDOW_KM / SLICE_KM)
    v = stretches(densities(slice_values(slices, taste)), most, taste, mix)
    best = F.max(F.when(F.col("fun").isNotNull(), F.struct("fun", (-F.col("i")).alias("back"), "mean_dens", "bends", "terrain", "scene", "pinned", "rolling", "width")))
    v = v.withColumn("best", best.over(Window.partitionBy("road")))
    share = lambda c: F.count_if(c) * SLICE_KM
    out = v.groupBy("road").agg(
        F.first("best").alias("b"), share(F.round("dens", 9) >= F.round(0.5 * F.col("best.mean_dens"), 9)).alias("good_km"), F.count("*").alias("slices"),
        F.max(F.struct(F.round("dens", 9).alias("d"), (-F.col("i")).alias("back"))).alias("top"), F.avg("scenery").alias("scenery_mean"),
        share(F.col("v") >= 0.5).alias("view_km"), share(F.col("p") >= 0.5).alias("drop_km"), share(F.col("high") >= 0.5).alias("alpine_km"), F.sum("x").alias("viewpoints"), F.avg("u").alias("built"),
    )
    linear = 100 * (F.col("b.fun") / (F.col("b.width") * SLICE_KM)) * WINDOW_KM * F.sqrt(F.least("good_km", F.lit(GOOD_KM_CAP)) / WINDOW_KM) / (SCORE_REF * taste_scale(taste, mix))
    out = out.withColumn("linear", linear)
    return out.select(
        "road", js_round(F.least(F.lit(100.0), F.round("linear", 9))).cast("long").alias("score"), "linear", "good_km", "slices", (-F.col("b.back")).alias("start"), "b.bends", "b.terrain", F.col("b.scene").alias("scenery"), F.col("b.pinned").alias("hairpins"), "b.rolling",
        ((-F.col("top.back") + 0.5) * SLICE_KM * 1000).alias("peak_m"), js_round(F.round(100 * F.col("scenery_mean"), 9)).cast("long").alias("scenery_score"), "view_km", "drop_km", "alpine_km", "viewpoints", js_round(F.round(100 * F.col("built"), 9)).cast("long").alias("built_pct"),
    )


def best_bits(slices: DataFrame, roads: DataFrame, taste: float = 0.5, mix: Mix = Mix()) -> DataFrame:
    """(road, bit_score, from_m, to_m): the best five km of roads that are worth it for that alone.

    roads: road, pass_name, has_ref, ref, name, road_text, narrow. A road counts with a pass or a number: of its ref where it has that field, else of its name or text.
    """
    most = round(BIT_KM / SLICE_KM)
    numbered = lambda c: F.coalesce(F.col(c).rlike(NUMBERED), F.lit(False))
    proper = roads.where(
        F.col("pass_name").isNotNull() | F.when(F.col("has_ref"), numbered("ref")).otherwise(numbered("name") | numbered("road_text"))
    ).where(F.coalesce("narrow", F.lit(0)) < 20).select("road")
    v = stretches(
        slice_values(slices.join(proper, "road", "left_semi"), taste), most, taste, mix
    ).where((F.col("nb") >= most) & F.col("fun").isNotNull() & (F.round("built", 9) <= 0.2))
    best = v.groupBy("road").agg(F.max(F.struct("fun", (-F.col("i")).alias("back"))).alias("b"))
    value = 100 * (F.col("b.fun") / BIT_KM) * WINDOW_KM / (SCORE_REF * taste_scale(taste, mix))
    start = -F.col("b.back") * 200
    return best.select("road", js_round(F.least(F.lit(100.0), F.round(value, 9))).cast("long").alias("bit_score"), start.alias("from_m"), (start + most * 200).alias("to_m"))


def hot_spots(slices: DataFrame, taste: float = 0.5) -> DataFrame:
    """(road, from_m, to_m): runs of two slices or more within 70 % of the densest, joined where one slice or none lies between."""
    d = densities(slice_values(slices, taste)).withColumn("dens", F.round("dens", 9))
    d = d.withColumn("on", F.col("dens") >= F.round(0.7 * F.max("dens").over(Window.partitionBy("road")), 9))
    w = Window.partitionBy("road").orderBy("i")
    runs = d.where("on").withColumn("run", F.col("i") - F.row_number().over(w)).groupBy("road", "run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b")).where("b - a >= 2")
    o = Window.partitionBy("road").orderBy("a")
    new = F.when(F.col("a") - F.lag("b").over(o) <= 1, 0).otherwise(1)
    return runs.withColumn("new", new).withColumn("spot", F.sum("new").over(o)).groupBy("road", "spot").agg(
        (F.min("a") * 200).alias("from_m"), (F.max("b") * 200).alias("to_m")
    ).drop("spot")


def top_roads(scores: DataFrame, most: int, by: str = "score", order: str = "road") -> DataFrame:
    """The first roads by a score, ties by order: one TakeOrdered."""
    return scores.orderBy(F.desc(by), order).limit(most)


#: Settings that a taste is chosen from: 11 tastes, with each of 27 mixes.
SETTINGS = [(k / 10, Mix(t, s, h)) for k in range(11) for t in (0.5, 1.0, 1.5) for s in (0.5, 1.0, 1.5) for h in (0.5, 1.0, 1.5)]
#: Starts of stretches that are held against all settings at a time.
STARTS = 2048


def class_stretches(slices: DataFrame) -> DataFrame:
    """What scores at all tastes need of each slice, worked out once a road: road, i, d1..d4 (densities by class of bend), and for the stretch of up to 15 km that starts there, width,
    s1..s4 (bends by class), m1..m4 (mean densities by class), terrain, scene and pins, the gains of a plain mix at a hairpin bonus of 1; s1 is null where the stretch would leave the road.

    Bends and densities are sums of their classes times a taste's weights, so no window depends on a setting.
    """
    most, w = round(WINDOW_KM / SLICE_KM), Window.partitionBy("road").orderBy("i")
    so_far, frame, near = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, most - 1), w.rowsBetween(-2, 2)
    v = slice_values(slices)
    one = lambda k: slice_bends([F.col(c) if c == f"c{k}" else F.lit(0) for c in COUNTS], F.col("u"), [1.0] * 4)
    v = v.withColumns({f"b{k}": one(k) for k in range(1, 5)}).withColumn("width", F.least("nb", F.lit(most)))
    v = v.withColumns({f"d{k}": F.avg(F.col(f"b{k}") * (1 + 0.5 * F.col("scenery")) / SLICE_KM).over(near) for k in range(1, 5)})
    of = {f"s{k}": f"b{k}" for k in range(1, 5)} | {f"m{k}": f"d{k}" for k in range(1, 5)} | {"pins": "hairpins", "views": "scenery", "turns": "r"}
    v = v.withColumns({"relief": F.max("ele").over(frame) - F.min("ele").over(frame), **{f"run_{n}": F.sum(F.col(c).cast("double")).over(so_far) for n, c in of.items()}})
    # the last row's sums stand for ends beyond it, so one lead is enough
    ends = F.struct(*(F.col(f"run_{n}").alias(n) for n in of))
    v = v.withColumn("end", F.coalesce(F.lead(ends, most - 1).over(w), F.last(ends).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    v = v.withColumns({n: F.col("end")[n] - F.col(f"run_{n}") + F.col(c) for n, c in of.items()})
    climb, rolling = terrain_parts(F.col("relief"), F.col("turns"), F.col("width") * SLICE_KM)
    fits = F.col("i") + F.col("width") <= F.col("nb")
    means = [(F.col(f"m{k}") / F.col("width")).alias(f"m{k}") for k in range(1, 5)]
    gains = [(0.5 * F.greatest(climb, rolling)).alias("terrain"), (0.5 * F.col("views") / F.col("width")).alias("scene"), (hairpin_factor(F.col("pins"), 1.0) - 1).alias("pins")]
    return v.select("road", "i", "width", *(f"d{k}" for k in range(1, 5)), F.when(fits, F.col("s1")).alias("s1"), "s2", "s3", "s4", *means, *gains)


def setting_scores(slices: DataFrame, settings: list[tuple[float, Mix]]) -> DataFrame:
    """(road, linear array<double>): each road's linear score at every setting (taste, mix), in their order.

    A road's stretches meet all settings as a product of matrices, STARTS at a time; the first of equal stretches counts, and values are compared to nine decimals. What depends on the taste
    alone is worked out once a taste: bends, and densities, which are sorted once and not held against each setting's limit. Only the best of a setting's values is rounded.
    """
    tastes = list(dict.fromkeys(t for t, _ in settings))
    of = np.array([tastes.index(t) for t, _ in settings])
    weights = np.array([taste_weights(t)[0] for t in tastes]).T
    mixes = np.array([[m.terrain, m.scenery, m.hairpins * taste_weights(t)[1]] for t, m in settings]).T
    scales = np.array([taste_scale(t, m) for t, m in settings])
    classes = lambda table, name: np.stack([table.column(f"{name}{k}").to_numpy() for k in range(1, 5)], axis=1)

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        starts = table.filter(pc.is_valid(table.column("s1")))
        best, at, each = np.full(len(settings), -np.inf), np.zeros(len(settings), np.int64), np.arange(len(settings))
        for a in range(0, len(starts), STARTS):
            some = starts.slice(a, STARTS)
            gains = np.stack([some.column(c).to_numpy() for c in ("terrain", "scene", "pins")], axis=0)
            fun = mixes.T @ gains
            fun += 1
            fun *= (classes(some, "s") @ weights).T[of]
            top = np.round(fun.max(axis=1), 9)
            # the first that is within the last decimal of the top mostly has its rounded value; where not, all of the row are rounded
            first = (fun >= top[:, None] - 1e-9).argmax(axis=1)
            for row in np.flatnonzero(np.round(fun[each, first], 9) != top):
                first[row] = (np.round(fun[row], 9) == top[row]).argmax()
            at, best = np.where(top > best, first + a, at), np.maximum(best, top)
        means, width = classes(starts, "m")[at], starts.column("width").to_numpy()[at]
        least = np.round(0.5 * (means * weights.T[of]).sum(axis=1), 9)
        good = np.zeros(len(settings))
        for a in range(0, len(table), STARTS):
            dens = np.sort(np.round((classes(table.slice(a, STARTS), "d") @ weights).T, 9), axis=1)
            for t in range(len(tastes)):
                good[of == t] += dens.shape[1] - np.searchsorted(dens[t], least[of == t])
        linear = 100 * best / (width * SLICE_KM) * WINDOW_KM * np.sqrt(np.minimum(good * SLICE_KM, GOOD_KM_CAP) / WINDOW_KM) / (SCORE_REF * scales)
        return pa.table({"road": table.column("road")[:1], "linear": [np.round(linear, 9)]})

    kind = slices.schema["road"].dataType.simpleString()
    return class_stretches(slices).groupBy("road").applyInArrow(score, f"road {kind}, linear array<double>")


def agreement(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """(ord, agree, yays, nays) of each setting: in how many pairs of a liked and a disliked road the liked one's linear score is greater.

    scores: road, linear (an array, a value a setting); ratings: road, rating (above 0 or below). No pairs are made: along a setting's scores in order, each liked road
    counts the disliked ones of lower score.
    """
    e = scores.join(ratings.select("road", "rating"), "road").select("rating", F.posexplode("linear").alias("ord", "linear"))
    no, yes = F.when(F.col("rating") < 0, 1).otherwise(0), F.when(F.col("rating") > 0, 1).otherwise(0)
    level = e.groupBy("ord", "linear").agg(F.sum(no).alias("no"), F.sum(yes).alias("yes"))
    below = Window.partitionBy("ord").orderBy("linear").rowsBetween(Window.unboundedPreceding, -1)
    return level.withColumn("below", F.coalesce(F.sum("no").over(below), F.lit(0))).groupBy("ord").agg(
        F.sum(F.col("yes") * F.col("below")).alias("agree"), F.sum("yes").alias("yays"), F.sum("no").alias("nays")
    )


def learn_taste(slices: DataFrame, ratings: DataFrame) -> DataFrame:
    """The setting of 11 tastes and 27 mixes that ranks most liked roads above disliked ones; no row with fewer than two of either.

    ratings: road, rating (1 or -1). Ties go to the setting nearest the defaults, then to the first. Returns taste, terrain, scenery, hairpins, agree, pairs, yays, nays.
    """
    rated = slices.join(ratings.select("road"), "road", "left_semi")
    sums = agreement(setting_scores(rated, SETTINGS), ratings).where("yays >= 2 AND nays >= 2")
    named = [F.struct(F.lit(t).alias("taste"), F.lit(m.terrain).alias("terrain"), F.lit(m.scenery).alias("scenery"), F.lit(m.hairpins).alias("hairpins")) for t, m in SETTINGS]
    s = sums.withColumn("s", F.get(F.array(*named), F.col("ord"))).select("*", "s.*")
    drift = F.abs(F.col("taste") - 0.5) + sum((F.abs(F.col(c) - 1) for c in ("terrain", "scenery", "hairpins")), F.lit(0.0))
    best = s.withColumn("key", F.round(F.col("agree") - 0.01 * drift, 9)).orderBy(F.desc("key"), "ord").limit(1)
    return best.select("taste", "terrain", "scenery", "hairpins", "agree", (F.col("yays") * F.col("nays")).alias("pairs"), "yays", "nays")

"""Recorded tracks: GPX in and out, and roads as GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<_lat: string, _lon: string, ele: string>"
GPX = f"struct<metadata: struct<name: string>, trk: array<struct<name: string, trkseg: array<struct<trkpt: array<{POINT}>>>>>, rte: array<struct<name: string, rtept: array<{POINT}>>>>"


def parse_gpx(files: DataFrame, least_m: float = 20.0) -> DataFrame:
    """(file, name, points) of GPX texts (file, content): track and route points, whichever kind the text has first, the first and each at least least_m from the last kept, to five decimals.

    A file with fewer than two finite points, or that is no XML, has points null. The name is the track's, the file's metadata's, the route's, or the file's own.
    """
    g = files.withColumn("g", F.from_xml(F.col("content"), GPX, {"mode": "PERMISSIVE"}))
    tracks = F.coalesce(F.flatten(F.transform(F.flatten(F.transform("g.trk", lambda t: F.coalesce(t.trkseg, F.array()))), lambda s: F.coalesce(s.trkpt, F.array()))), F.array())
    routes = F.coalesce(F.flatten(F.transform("g.rte", lambda r: F.coalesce(r.rtept, F.array()))), F.array())
    route_at, track_at = F.locate("<rtept", F.col("content")), F.locate("<trkpt", F.col("content"))
    flat = F.when((route_at > 0) & (route_at < track_at), F.concat(routes, tracks)).otherwise(F.concat(tracks, routes))
    points = F.filter(
        F.transform(flat, lambda p: F.struct(p._lon.try_cast("double").alias("lon"), p._lat.try_cast("double").alias("lat"))),
        lambda p: p.lon.isNotNull() & p.lat.isNotNull() & ~F.isnan(p.lon) & ~F.isnan(p.lat) & (F.abs(p.lon) < float("inf")) & (F.abs(p.lat) < float("inf"))
    )
    name = F.coalesce(
        F.nullif(F.get("g.trk", F.lit(0)).getField("name"), F.lit("")), F.nullif(F.col("g.metadata.name"), F.lit("")),
        F.nullif(F.get("g.rte", F.lit(0)).getField("name"), F.lit("")), F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"(?i)\.gpx$", "")
    )
    return g.select("file", name.alias("name"), F.when(F.size(points) >= 2, thinned(points, least_m)).alias("points"))


def import_errors(files: DataFrame) -> DataFrame:
    """(file, error) of files (file, content) that give no ride: no GPX by their ending, no XML, or fewer than two points. The others import all the same."""
    name = F.regexp_replace("file", "^.*/", "")
    ending = name.rlike(r"(?i)\.gpx$")
    read = parse_gpx(files.where(ending)).select("file", "points")
    whole = F.from_xml(F.col("content"), "_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = F.col("content").isNull() | whole["_corrupt"].isNotNull()
    why = F.when(~ending, F.concat(name, F.lit(" isn't a .gpx file"))).when(broken, F.concat(name, F.lit(" isn't a valid GPX file"))).when(
        F.col("points").isNull(), F.concat(name, F.lit(" has no track points"))
    )
    return files.join(read, "file", "left").select("file", why.alias("error")).where("error IS NOT NULL")


def thinned(points: Column, least_m: float) -> Column:
    """The first point, and each at least least_m from the last one kept; all, if that is 0."""
    from ..functions.geo import RIDE_DEG_M, planar_m

    far = lambda a, b: planar_m(a.lon, a.lat, b.lon, b.lat, RIDE_DEG_M) >= least_m
    start = F.array().cast("array<struct<lon: double, lat: double>>")
    kept = points if least_m <= 0 else F.aggregate(points, start, lambda out, p: F.when(F.size(out) == 0, F.array(p)).when(far(F.element_at(out, -1), p), F.concat(out, F.array(p))).otherwise(out))
    return F.transform(kept, lambda p: F.struct(F.round(p.lon, 5).alias("lon"), F.round(p.lat, 5).alias("lat")))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_gpx(name: Column, points: Column) -> Column:
    """A track of points (lon, lat, ele) as GPX text."""
    number = lambda x: F.call_function("format_number", x.cast("double"), F.lit("0.##########"))
    one = lambda p: F.concat(F.lit('<trkpt lat="'), number(p.lat), F.lit('" lon="'), number(p.lon), F.lit('"><ele>'), number(p.ele), F.lit("</ele></trkpt>"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1"><trk><name>'), escaped(name), F.lit("</name><trkseg>"),
        F.array_join(F.transform(points, one), ""), F.lit("</trkseg></trk></gpx>")
    )


def gpx_file_name(name: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(name, r"[^\w\-]+", "_")), F.lit(".gpx"))


def _feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    """A GeoJSON feature; null properties are left out."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(*(v.alias(n) for n, v in properties.items())).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")
        )
    )


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p.lon, p.lat))


def line_feature(road: Column, score: Column, points: Column) -> Column:
    """A road's line with its id and score."""
    return _feature("LineString", _pairs(points), id=road, score=score)


def run_feature(cls: Column, points: Column) -> Column:
    """A run of bends of one class."""
    return _feature("LineString", _pairs(points), c=cls)


def ride_feature(name: Column, points: Column) -> Column:
    return _feature("LineString", _pairs(points), name=name)


def hot_feature(points: Column) -> Column:
    """A stretch of a road that is worth most, without properties."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), _pairs(points).alias("coordinates")).alias("geometry")))


def pass_feature(name: Column, ele: Column, lon: Column, lat: Column) -> Column:
    """A pass with its label, the elevation in a line of its own where there is one."""
    return _feature("Point", F.array(lon, lat), label=F.concat(name, F.coalesce(F.concat(F.lit("\n"), ele.cast("string"), F.lit(" m")), F.lit(""))))


def stop_feature(place: Column, icon: Column, kind: Column, name: Column, lon: Column, lat: Column) -> Column:
    """A stop with its icon, its place in the list, and its kind and name as a label."""
    return _feature("Point", F.array(lon, lat), icon=icon, i=place, label=F.concat_ws(": ", kind, name))

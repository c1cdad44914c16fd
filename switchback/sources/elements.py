"""Map elements as JSON, and tiles of roads as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import rideable, tag

# The classes of ways and kinds of places that are asked for.
HIGHWAYS = ("trunk", "primary", "secondary", "tertiary", "unclassified")
PLACES = ("city", "town", "village")
ELEMENT = "type string, id long, nodes array<long>, geometry array<struct<lat: double, lon: double>>, lat double, lon double, tags map<string, string>"


def read_elements(spark: SparkSession, path: str, tiles: list[str] | None = None) -> DataFrame:
    """Elements of JSON files (an array each), one a tile; with tiles given, all of them must be there."""
    df = spark.read.schema(ELEMENT).option("multiLine", True).json(path).withColumn("tile", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    if tiles is not None:
        missing = set(tiles) - {r.tile for r in df.select("tile").distinct().where(F.col("tile").isin(tiles)).collect()}
        if missing:
            raise FileNotFoundError(f"tiles without a file: {', '.join(sorted(missing))}")
    return df


def requested(elements: DataFrame, s: float, w: float, n: float, e: float) -> DataFrame:
    """What a request for a box (four decimals, edges counting) holds: ways of HIGHWAYS with a vertex in it, passes, viewpoints and PLACES in it."""
    s, w, n, e = (round(x, 4) for x in (s, w, n, e))
    inside = lambda p: p.lat.between(s, n) & p.lon.between(w, e)
    t = lambda k: F.try_element_at("tags", F.lit(k))
    way = (F.col("type") == "way") & t("highway").isin(*HIGHWAYS) & F.exists("geometry", inside)
    node = (F.col("type") == "node") & F.col("lat").between(s, n) & F.col("lon").between(w, e) & (
        F.coalesce(t("mountain_pass") == "yes", F.lit(False)) | F.coalesce(t("tourism") == "viewpoint", F.lit(False)) | F.coalesce(t("place").isin(*PLACES), F.lit(False))
    )
    return elements.where(F.coalesce(way, F.lit(False)) | F.coalesce(node, F.lit(False)))


def write_elements(elements: DataFrame, path: str) -> None:
    """The elements of cells (tile, ord, and ELEMENT's columns) as Parquet by tile; of equal types and ids of a tile, the last."""
    rest = [c for c in elements.columns if c not in ("tile", "ord", "type", "id", "tags")]
    last = elements.groupBy("tile", "type", "id").agg(F.max(F.struct("ord", *rest, F.map_entries("tags").alias("t"))).alias("x"))
    last.select("tile", "x.ord", "type", "id", *(f"x.{c}" for c in rest), F.map_from_entries("x.t").alias("tags")).write.mode("overwrite").partitionBy("tile").parquet(path)


def classified(elements: DataFrame) -> DataFrame:
    """elements with kind: way (two nodes or more, a geometry, rideable), pass, place (with a name), viewpoint, or null. A key that is there counts, whatever its value."""
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    way = F.col("type") == "way"
    good = (F.size("nodes") >= 2) & F.col("geometry").isNotNull() & rideable(F.coalesce("tags", F.create_map().cast("map<string, string>")))
    kind = F.when(way, F.when(good, "way")).when(has("mountain_pass"), "pass").when(
        has("place") & tag(F.col("tags"), "name").isNotNull(), "place"
    ).when(tag(F.col("tags"), "tourism") == "viewpoint", "viewpoint")
    return elements.withColumn("kind", kind)


def write_tiles(roads: DataFrame, path: str) -> None:
    roads.write.mode("overwrite").partitionBy("tile").parquet(path)


def read_tiles(spark: SparkSession, path: str, keys: list[str], version: int = 3) -> DataFrame:
    """The roads of some tiles of a version; other tiles are not opened."""
    return spark.read.parquet(path).where(F.col("tile").isin(keys) & (F.col("version") == version))


def tile_index(roads: DataFrame) -> DataFrame:
    """(tile, roads, ids): how many roads a tile has, and their ids in order, comma-joined; a tile's roads are bounded (250)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "road_id"))), lambda x: x.road_id.cast("string")), ",")
    return roads.groupBy("tile").agg(F.count("*").alias("roads"), ids.alias("ids"))

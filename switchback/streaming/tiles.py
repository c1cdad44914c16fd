"""The index of tiles kept up to date as tiles change: what a change does not touch is not written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tiles import BITS_KEPT, top_bits
from ..sources.elements import tile_index

#: The tables under an index's folder, each a partition a tile.
ROADS, INDEX, BITS = "roads", "index", "bits"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    jvm, at = spark._jvm, f"{path}/{name}"
    where = jvm.org.apache.hadoop.fs.Path(at)
    return spark.read.parquet(at) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def apply_changes(changes: DataFrame, path: str, most: int = BITS_KEPT) -> None:
    """Put changed tiles in place of what an index holds of them.

    changes: tile string, version long, pos, id, score, bit_score (null for a road without a bit), and others: all rows of a tile's version, or one row without an id for a tile that has
    become empty. Of several versions of a tile the greatest counts, and one that is no newer than what is there is left out, so a batch that comes twice, or late, changes
    nothing. Roads, the tile's line of the index and its best bits are written by partition; other tiles' files stay as they are.
    """
    spark = changes.sparkSession
    newest = changes.groupBy("tile").agg(F.max("version").alias("version"))
    there = _table(spark, path, INDEX)
    if there is not None:
        old = there.select(F.col("tile").cast("string").alias("tile"), F.col("version").alias("had"))
        newest = newest.join(old, "tile", "left").where("had IS NULL OR version > had").drop("had")
    newest = newest.persist()
    try:
        if newest.isEmpty():
            return
        rows = changes.join(newest, ["tile", "version"], "left_semi")
        roads = rows.where("id IS NOT NULL")
        counted = tile_index(roads.select("tile", F.col("pos").alias("ord"), F.col("id").alias("road_id")))
        index = newest.join(counted, "tile", "left").select("tile", "version", F.coalesce("roads", F.lit(0)).cast("long").alias("roads"), F.coalesce("ids", F.lit("")).alias("ids"))
        w = Window.partitionBy("tile").orderBy(F.desc("bit_score"), F.desc("score"), "pos")
        best = roads.where("bit_score IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")
        # a tile without rows keeps one that says so, as a partition can only be replaced
        none = newest.select("tile", "version")
        for name, df in ((ROADS, roads), (BITS, best)):
            _replace(df.unionByName(none.join(df.select("tile").distinct(), "tile", "left_anti"), allowMissingColumns=True), f"{path}/{name}")
        _replace(index, f"{path}/{INDEX}")  # last: until then the tile counts as not yet changed, and the batch comes again
    finally:
        newest.unpersist()


def _replace(rows: DataFrame, path: str) -> None:
    rows.repartition("tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(path)


def follow(changes: DataFrame, path: str, checkpoint: str, most: int = BITS_KEPT) -> StreamingQuery:
    """apply_changes() for each batch of a stream, all that has come so far."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply_changes(batch, path, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(tile, version, roads, ids) of all tiles."""
    return spark.read.parquet(f"{path}/{INDEX}").select(F.col("tile").cast("string").alias("tile"), "version", "roads", "ids")


def roads_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The roads of some tiles; others are not opened."""
    return spark.read.parquet(f"{path}/{ROADS}").where(F.col("tile").cast("string").isin(keys) & F.col("id").isNotNull())


def bits_of(spark: SparkSession, path: str, most: int = BITS_KEPT) -> DataFrame:
    """The best bits of all tiles, from each tile's own best."""
    return top_bits(spark.read.parquet(f"{path}/{BITS}").where("id IS NOT NULL"), most)

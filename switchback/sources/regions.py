"""Map elements laid out along a curve through space, with the box and the classes of each file beside them, so that a request opens the files that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quadtree import curve
from .elements import requested

#: Files that a request names one by one; a request of more reads the folder, where Parquet's own statistics prune.
MOST_FILES = 10_000
EDGES = ("s", "w", "n", "e")


def class_of(elements: DataFrame) -> Column:
    """What an element is asked for as: the highway of a way; pass, the place or viewpoint of a node, the first that holds; else null."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    node = F.when(t("mountain_pass") == "yes", "pass").when(t("place").isNotNull(), t("place")).when(t("tourism") == "viewpoint", "viewpoint")
    return F.when(F.col("type") == "way", t("highway")).otherwise(node)


def lay_out(elements: DataFrame, path: str, files: int) -> None:
    """Write elements (type, geometry, lat, lon, tags, and others) in about so many files, with their boxes (s, w, n, e) and class as columns.

    Files hold ranges of a curve through space, so each covers a small box and a region lies in few of them. A second table has a row a file: its box, classes and
    rows. An element without a place is kept, in the first file; no request for a box holds it. An empty table gives no boxes.
    """
    side = lambda end, axis, one: F.coalesce(end(F.transform("geometry", lambda p: p[axis])), F.col(one))
    placed = elements.withColumns(
        {
            "s": side(F.array_min, "lat", "lat"), "w": side(F.array_min, "lon", "lon"), "n": side(F.array_max, "lat", "lat"),
            "e": side(F.array_max, "lon", "lon"), "class": class_of(elements)
        }
    )
    order = curve((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2)
    ranged = placed.withColumn("order_", order).repartitionByRange(files, "order_").sortWithinPartitions("order_").drop("order_")
    ranged.write.mode("overwrite").parquet(f"{path}/elements")
    kept = elements.sparkSession.read.parquet(f"{path}/elements").select(*EDGES, "class", F.col("_metadata.file_name").alias("file"))
    ends = [F.min("s").alias("s"), F.min("w").alias("w"), F.max("n").alias("n"), F.max("e").alias("e")]
    kept.groupBy("file").agg(*ends, F.collect_set("class").alias("classes"), F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/boxes")


def read_region(spark: SparkSession, path: str, s: float, w: float, n: float, e: float, classes: list[str] | None = None) -> DataFrame:
    """requested() of what lay_out() wrote, in the same columns: only files whose box meets the region, and that hold one of the classes if given, are opened.

    Within a file, the box and the class are filters of the scan itself (on plain columns, which Parquet's row groups have statistics of).
    """
    s, w, n, e = (round(x, 4) for x in (s, w, n, e))
    meets = (F.col("s") <= n) & (F.col("n") >= s) & (F.col("w") <= e) & (F.col("e") >= w)
    boxes = spark.read.parquet(f"{path}/boxes").where(meets)
    if classes is not None:
        boxes = boxes.where(F.arrays_overlap("classes", F.array(*map(F.lit, classes)).cast("array<string>")))
    names = [r.file for r in boxes.select("file").limit(MOST_FILES + 1).collect()]
    whole = spark.read.parquet(f"{path}/elements")
    if not names:
        found = whole.limit(0)
    elif len(names) > MOST_FILES:
        found = whole
    else:
        found = spark.read.schema(whole.schema).parquet(*(f"{path}/elements/{x}" for x in names))
    found = found.where(meets) if classes is None else found.where(meets & F.col("class").isin(classes))
    return requested(found, s, w, n, e).drop(*EDGES, "class")

"""Track points as they arrive, thinned and merged into a table of cells that have been ridden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import cell


def ridden_cells(points: DataFrame, size: float = 0.001, late: str = "1 hour") -> DataFrame:
    """(window, cell_x, cell_y, points) of a stream of points (ts, lon, lat): an hour's points by cell, closed when later ones are past the watermark."""
    p = points.withWatermark("ts", late)
    return p.groupBy(F.window("ts", "1 hour"), cell(F.col("lon"), size).alias("cell_x"), cell(F.col("lat"), size).alias("cell_y")).agg(F.count("*").alias("points"))


def append_to(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet table, all that has come so far."""
    return cells.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

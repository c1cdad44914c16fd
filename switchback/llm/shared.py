"""What the operators share: written tables, the size of Arrow batches, and values evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, shared_dir
from ..storage import stored as written

__all__ = ["kept", "let", "shared_dir", "small_batches", "written"]


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to and from Python hold no more than 1,000 rows and 8 MB in this session, as texts and blocks of an index are large rows."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once; a column's expression would be put in wherever a lambda names it, and evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

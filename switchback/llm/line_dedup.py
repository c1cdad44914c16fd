"""Line dedup by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, written

#: Boilerplate lines up to this number are broadcast (about 2 MB of hashes and hosts); beyond it the hosts are joined by a shuffle.
MOST_BROADCAST = 50_000


def lines_of(text: Column) -> Column:
    """The \\n-split lines of a text; none for null."""
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def has_text(line: Column) -> Column:
    """Whether a line holds anything but ASCII white space."""
    return F.length(F.btrim(line, F.lit(" \t\v\f\r"))) > 0


def boilerplate(docs: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(host, line hash) of lines on more than ratio of their host's pages and on least_pages of them at least. docs: host, text.

    A page counts once for a line that it repeats. Counts are summed before the shuffle, so a host or line with a third of
    all rows arrives as one row a task.
    """
    totals = written(docs.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    seen = docs.select("host", F.explode(F.array_distinct(lines_of(F.col("text")))).alias("line")).where(has_text(F.col("line")))
    counts = seen.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return written(counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line"), "boilerplate")


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.05, least_pages: int = 10, counts: bool = True) -> DataFrame:
    """Drop the lines that stand on more than a share ``ratio`` of their host's pages.

    docs: text string, a host column, and any others. Returns every row of docs with all its columns, text without its boilerplate lines, and
    n_lines and n_dropped (replacing columns of these names; without counts, there are none, and all columns but text keep their values). A line is all between two line feeds; it is known by a 64-bit
    hash within its host, and lines of white space alone are never dropped. A null text stays null, with no lines; a null host is a host of its own,
    distinct from the empty one; repeated rows are pages of their own. A host with fewer than least_pages pages loses nothing, as a ratio says
    little there. Ties do not arise: a line at exactly the ratio stays. An empty table gives no rows.

    On a host with L lines a page in the mean, at most L / ratio lines can be boilerplate, so each host's list is bounded. The lists are broadcast up to
    MOST_BROADCAST lines, so that texts are not shuffled; beyond that they are joined by the host, with the large side splittable.
    """
    named = docs.select(F.struct("*").alias("row"), F.to_json(F.struct(F.col(host).cast("string").alias("h"))).alias("host"), F.col("text").cast("string").alias("text"))
    found = boilerplate(named, ratio, least_pages)
    lists = found.groupBy("host").agg(F.collect_list("line").alias("drop"))
    joined = named.join(F.broadcast(lists) if found.count() <= MOST_BROADCAST else written(lists, "lists").hint("merge"), "host", "left")
    # which of the page's lines are dropped, by one set operation; then each line is sought among those few
    gone = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.col("drop"))
    kept = let(gone, lambda g: F.when(F.size(g) > 0, F.filter("lines", lambda x: ~has_text(x) | ~F.array_contains(g, F.xxhash64(x)))).otherwise(F.col("lines")))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept)
    split = joined.withColumn("lines", lines_of(F.col("text"))).withColumn("kept", kept)
    out = [
        F.col(f"row.`{c}`").alias(c) if c != "text" else F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text") for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")
    ]
    if not counts:
        return split.select(*out)
    return split.select(*out, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by their source."""
    out = without_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT source, line FROM l WHERE length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0
  GROUP BY source, line
  HAVING count(DISTINCT doc_id) >= 10
     AND count(DISTINCT doc_id) > 0.05::DOUBLE * (SELECT count(*) FROM documents d WHERE d.source IS NOT DISTINCT FROM l.source)),
k AS (
  SELECT l.doc_id, l.line, l.i, f.line IS NOT NULL AS gone FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(sum(k.gone::INT), 0)::BIGINT AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (NOT k.gone), '')) END AS text_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""

"""Views of the test tables as road data: the same SQL for Spark and for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SLICES = """
SELECT road, i, c1, c2, c3, c4, h, r, CAST(v AS DOUBLE) / 9 AS v, CAST(p AS DOUBLE) / 9 AS p, CAST(u AS DOUBLE) / 20 AS u, x, CAST(ele AS DOUBLE) AS ele, CAST(45 + road % 9 AS DOUBLE) AS lat FROM (
  SELECT l_suppkey AS road, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i,
    l_partkey % 6 AS c1, l_orderkey % 5 AS c2, CAST(l_quantity AS INT) % 5 AS c3, l_linenumber % 3 AS c4, CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS h, l_partkey % 4 AS r,
    l_orderkey % 10 AS v, l_partkey % 10 AS p, CASE WHEN l_orderkey % 11 = 0 THEN 14 ELSE 0 END AS u, CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS x, 600 + (l_partkey * 7 + l_orderkey) % 1900 AS ele
  FROM {lineitem}) s"""

PATH = """
SELECT road, k, ele, sum(10 * cos(radians(turn))) OVER w AS x, sum(10 * sin(radians(turn))) OVER w AS y FROM (
  SELECT user_id AS road, row_number() OVER o - 1 AS k, value AS ele, CAST(sum((event_id * 7919) % 101 - 50) OVER o AS DOUBLE) AS turn FROM {events}
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) p
WINDOW w AS (PARTITION BY road ORDER BY k)"""

POINTS = """
SELECT vec_id AS point_id, 7 + CAST({e}(embedding, 1) AS DOUBLE) / 4 AS lon, 46 + CAST({e}(embedding, 2) AS DOUBLE) / 4 AS lat, label,
  CASE label % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'town' ELSE 'village' END AS kind FROM {embeddings}"""

WAYS = """
SELECT o_orderkey AS way, o_orderkey * 31 % 20011 AS n0, (o_orderkey * 31 + 1 + o_custkey % 3) % 20011 AS n1 FROM {orders}"""

#: Ways whose ends meet at nodes of some four to twelve, with names and directions of small whole numbers, which multiply exactly.
JUNCTIONS = """
SELECT o_orderkey AS way, CAST(floor(o_orderkey / 16) AS BIGINT) AS n0, CAST(floor(o_orderkey / 16) AS BIGINT) + 1 + o_custkey % 2 AS n1, CASE WHEN o_custkey % 11 <> 0 THEN 'road ' || o_custkey % 3 END AS key,
  o_orderkey % 7 - 3 AS dx0, o_custkey % 7 - 3 AS dy0, o_custkey % 5 - 2 AS dx1, o_orderkey % 9 - 4 AS dy1 FROM {orders}"""

TAGS = """
SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' END AS surface, CASE p_partkey % 17 WHEN 0 THEN 'roundabout' END AS junction,
  CASE p_partkey % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'private; delivery' WHEN 3 THEN 'no;yes' WHEN 4 THEN '' END AS motorcycle, CASE p_size % 3 WHEN 0 THEN 'private' END AS access,
  CASE p_partkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS tunnel, CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN 'x' END AS layer, CASE p_size % 4 WHEN 0 THEN '1' END AS lanes,
  CASE p_partkey % 9 WHEN 0 THEN '4.5 m' WHEN 1 THEN '5' WHEN 2 THEN 'wide' WHEN 3 THEN '3' END AS width, CASE p_partkey % 8 WHEN 0 THEN 'FR:urban' WHEN 1 THEN '50' WHEN 2 THEN 'DE:Zone30' END AS maxspeed,
  CASE p_size % 6 WHEN 0 THEN 'd 17 ; D 18' WHEN 1 THEN '' END AS ref, p_name AS name, CASE p_partkey % 10 WHEN 0 THEN 'no @ (Nov 1-May 31)' WHEN 1 THEN 'yes @ (Su)' END AS conditional, CASE p_size % 7 WHEN 0 THEN 'yes' END AS seasonal
FROM {part}"""

AREAS = """
SELECT n_nationkey AS area_ord, n_regionkey % 2 = 0 AS complete, 45.6 + n_nationkey % 5 * 0.1 AS s, 6.6 + n_nationkey % 4 * 0.1 AS w, 45.75 + n_nationkey % 5 * 0.1 AS n, 6.85 + n_nationkey % 4 * 0.1 AS e FROM {nation}"""

SCANS = """
SELECT c_custkey AS ord, 'k' || c_custkey * 7 % 40 AS key, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS missing,
  45 + c_custkey * 13 % 17 * 0.11 - c_nationkey * 0.02 AS s, 6 + c_custkey * 29 % 19 * 0.13 - c_nationkey * 0.03 AS w, 45 + c_custkey * 13 % 17 * 0.11 + c_nationkey * 0.02 AS n, 6 + c_custkey * 29 % 19 * 0.13 + c_nationkey * 0.03 AS e
FROM {customer}"""

SCAN_ROADS = """
SELECT ord, road_id, name, pos FROM (SELECT o_custkey AS ord, o_orderkey * 13 % 997 AS road_id, o_orderpriority || o_orderkey AS name, o_orderkey AS pos,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey * 13 % 997 ORDER BY o_orderkey) AS k FROM {orders}) r WHERE k = 1"""

TABLES = ("customer", "lineitem", "events", "embeddings", "orders", "part", "nation")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text.replace("{e}", "element_at"), **used)


#: Slices that one task has, but for what one road holds.
SLICE_ROWS = 500_000


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SLICES of all line items. These are dealt by road before anything is made of them, to as many tasks as their number asks for; all windows of a road then find it in one task."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = max(spark.sparkContext.defaultParallelism, -(-l.count() // SLICE_ROWS))
    return spark.sql(SLICES, lineitem=l.repartition(parts, "l_suppkey"))


def check_sql(text: str) -> str:
    """The same view for the check's engine."""
    text = text.replace("{e}", "list_extract")
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text

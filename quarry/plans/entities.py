"""The engine's tables out of the driver's: parts as vehicles, suppliers or orders as clusters, line items as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import dealt, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for work on all line items; they are counted in the files' footers."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("y0"), F.max(F.year("l_shipdate")).alias("y1"))
    size = F.col("p_size")
    return table(spark, sf_dir, "part").join(years, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_type").alias("styles"), size.cast("string").alias("wheelbase"),
        F.lower(F.substring("p_type", 1, 1)).alias("construction"), F.when(size % 4 == 0, "r,4").when(size % 4 == 1, "f").when(size % 4 == 2, "a, r").otherwise("").alias("drive"),
        (F.col("y0") + size % 3).cast("int").alias("year_start"), (F.col("y1") - size % 4).cast("int").alias("year_end"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "engine_family").otherwise("structural")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cluster_id"), kind.alias("type"), F.col("s_name").alias("label"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, dealt out by vehicle once, so that neither their grouping nor a join with vehicles moves or sorts them again."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), line_tasks(spark, sf_dir), "l_partkey")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("note"))
    scope = F.when(F.col("l_suppkey") % 3 == 0, "engine-loop").otherwise("structural")
    return pairs.select(F.col("l_partkey").alias("vehicle_id"), F.col("l_suppkey").cast("string").alias("cluster_id"), scope.alias("scope"), F.lit("edc").alias("confidence"), "note")


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as small clusters of their parts."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vehicle_id"), F.col("l_orderkey").cast("string").alias("cluster_id")).distinct()
    return pairs.select("vehicle_id", "cluster_id", F.lit("structural").alias("scope"), F.when(F.col("vehicle_id") % 5 == 0, "edc-flagged").otherwise("edc").alias("confidence"))


VEHICLES = """vehicles AS (
  SELECT p_partkey AS id, p_brand AS make, p_name AS model, p_type AS styles, CAST(p_size AS VARCHAR) AS wheelbase,
    lower(substr(p_type, 1, 1)) AS construction, CASE p_size % 4 WHEN 0 THEN 'r,4' WHEN 1 THEN 'f' WHEN 2 THEN 'a, r' ELSE '' END AS drive,
    CAST(y0 + p_size % 3 AS INTEGER) AS year_start, CAST(y1 - p_size % 4 AS INTEGER) AS year_end
  FROM part JOIN (SELECT l_partkey, min(year(l_shipdate)) AS y0, max(year(l_shipdate)) AS y1 FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
CLUSTERS = """clusters AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS cluster_id, CASE WHEN s_suppkey % 3 = 0 THEN 'engine_family' ELSE 'structural' END AS type, s_name AS label FROM supplier)"""
MEMBERSHIP = """membership AS (
  SELECT l_partkey AS vehicle_id, CAST(l_suppkey AS VARCHAR) AS cluster_id, CASE WHEN l_suppkey % 3 = 0 THEN 'engine-loop' ELSE 'structural' END AS scope,
    'edc' AS confidence, min(l_returnflag) AS note FROM lineitem GROUP BY l_partkey, l_suppkey)"""
ORDER_MEMBERS = """order_members AS (
  SELECT DISTINCT l_partkey AS vehicle_id, CAST(l_orderkey AS VARCHAR) AS cluster_id, 'structural' AS scope,
    CASE WHEN l_partkey % 5 = 0 THEN 'edc-flagged' ELSE 'edc' END AS confidence FROM lineitem)"""
ALL = f"{VEHICLES},\n{CLUSTERS},\n{MEMBERSHIP}"

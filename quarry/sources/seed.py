"""A generated vehicle table: pairs of siblings, some of them made inconsistent by rule, and single vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS, SINGLES, FLAGGED = 907, 62, 110
SCHEMA = "id long, make string, model string, styles string, wheelbase string, construction string, drive string, year_start int, year_end int, cluster_id string"
#: Vehicles of four real clusters, in order.
KNOWN = [
    (-9, "Chevrolet", "Tahoe", "SUV", "116.0", "f", "r,4", 2007, 2014, "000100"),
    (-8, "GMC", "Yukon", "SUV", "116.0", "f", "r,4", 2007, 2014, "000100"),
    (-7, "Cadillac", "Escalade", "SUV", "116.0", "f", "r,4", 2007, 2014, "000100"),
    (-6, "BMW", "528,535,550", "Sedan", "113.7", "u", "r", 2004, 2010, "005280"),
    (-5, "BMW", "525,530", "Sedan", "113.7", "u", "r", 2004, 2007, "005280"),
    (-4, "BMW", "M5", "Sedan", "113.7", "u", "r", 2006, 2010, "005280"),
    (-3, "Scion", "FR-S", "Coupe", "101.2", "u", "r", 2013, 2016, "007710"),
    (-2, "Subaru", "BRZ", "Coupe", "101.2", "u", "r", 2013, 2016, "007710"),
    (-1, "Acura", "RL", "Sedan", "110.2", "u", "a", 2005, 2012, "009009"),
]


def known_vehicles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, SCHEMA)


def seed_vehicles(spark: SparkSession, pairs: int = PAIRS, singles: int = SINGLES, flagged: int = FLAGGED) -> DataFrame:
    """id, make, model, styles, wheelbase, construction, drive, year_start, year_end, cluster_id.

    Pair k is inconsistent for k up to flagged, in construction, drive, wheelbase or years by k modulo 4.
    """
    k, side = F.col("k"), F.col("side")
    padded = lambda x: F.lpad(x.cast("string"), 3, "0")
    mode = F.when(k <= flagged, k % 4)
    base = (F.lit(1994) + k % 18).cast("int")
    later = side == 1
    two = spark.range(1, pairs + 1).select(F.col("id").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
        (2 * k + side).alias("_ord"),
        F.concat(F.when(later, "SeedMakePeer").otherwise("SeedMake"), padded(k)).alias("make"),
        F.concat(F.lit("Series"), padded(k), F.when(later, "B").otherwise("A")).alias("model"),
        F.when(k % 5 == 0, "SUV").otherwise("Sedan").alias("styles"),
        F.when(mode == 0, "106.0").when(mode == 1, "108.0").when(mode == 2, F.when(later, "106.2").otherwise("104.0")).when(mode == 3, F.when(later, "110.4").otherwise("110.0")).otherwise(F.when(later, "109.6").otherwise("109.0")).alias("wheelbase"),
        F.when((mode == 0) & ~later, "f").otherwise("u").alias("construction"),
        F.when(mode == 0, "f").when(mode == 1, F.when(later, "r").otherwise("f")).when(mode == 2, "a").otherwise("r,4").alias("drive"),
        (base + F.when((mode == 3) & later, 4).when(mode.isNull() & later, 1).otherwise(0)).alias("year_start"),
        (base + F.when(mode == 3, F.when(later, 7).otherwise(2)).when(mode.isNull() & later, 7).otherwise(6)).alias("year_end"),
        (F.lit(100_000) + k).cast("string").alias("cluster_id"),
    )
    n = F.col("id")
    one = spark.range(singles).select(
        (F.lit(2 * pairs + 2) + n).alias("_ord"), F.concat(F.lit("SoloMake"), padded(n)).alias("make"), F.concat(F.lit("SoloModel"), padded(n)).alias("model"),
        F.when(n % 2 == 0, "Sedan").otherwise("Truck").alias("styles"), F.lit("111.0").alias("wheelbase"), F.when(n % 2 == 0, "u").otherwise("f").alias("construction"),
        F.when(n % 3 == 0, "f").otherwise("r").alias("drive"), (F.lit(1998) + n % 12).cast("int").alias("year_start"), (F.lit(2002) + n % 12).cast("int").alias("year_end"), (F.lit(100_000 + pairs + 1) + n).cast("string").alias("cluster_id"),
    )
    return two.unionByName(one).withColumnRenamed("_ord", "id")


def as_tables(vehicles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vehicles, clusters and membership of a table that names each vehicle's cluster."""
    clusters = vehicles.select("cluster_id").distinct().select("cluster_id", F.lit("structural").alias("type"), F.lit(None).cast("string").alias("label"), F.lit("EDC").alias("source"))
    membership = vehicles.select(F.col("id").alias("vehicle_id"), "cluster_id", F.lit("structural").alias("scope"), F.lit("edc").alias("confidence"), F.lit("").alias("note"))
    return vehicles.drop("cluster_id").withColumn("source", F.lit("EDC")), clusters, membership

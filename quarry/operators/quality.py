"""Consistency of clusters, flags and the verdict log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import first_number, strip

from .shared import dealt

METHOD = "consistency-check"
SPREAD = 1.0


def duplicate_tuples(membership: DataFrame, vehicles: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Combinations of keys that occur more than once among members; with a number of tasks, these are dealt out among so many."""
    return dealt(membership.join(vehicles, membership["vehicle_id"] == vehicles["id"]).select(*keys), tasks, *keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def value_set(column: Column, marks: str = ",") -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), f"[{marks}]"), strip), lambda p: p != ""))


def consistency(members: DataFrame, drive_marks: str = ",") -> DataFrame:
    """One row per cluster of more than one member, with what is wrong with it.

    One shuffle on the cluster computes all four checks: kinds of construction, a drive that all share
    (a value counted once per member that as many members have as have any), spread of wheelbases, and
    overlap of years. The shared drive is counted over (cluster, drive) pairs, so no list of a cluster's
    members is ever held.
    """
    own = members.withColumns({"_drives": value_set(F.col("drive"), drive_marks), "_base": first_number("wheelbase")})
    facts = own.groupBy("cluster_id").agg(
        F.count("*").alias("members"),
        F.min(F.nullif("construction", F.lit(""))).alias("_low"),
        F.max(F.nullif("construction", F.lit(""))).alias("_high"),
        F.count_if(F.size("_drives") > 0).alias("_driven"),
        (F.max("_base") - F.min("_base")).alias("_spread"),
        (F.max("year_start") > F.min("year_end")).alias("_apart"),
    )
    shared = own.select("cluster_id", F.explode("_drives").alias("_drive")).groupBy("cluster_id", "_drive").count().groupBy("cluster_id").agg(F.max("count").alias("_most"))
    rows = facts.join(shared, "cluster_id", "left").filter("members > 1")
    reasons = [
        F.when(F.col("_low") != F.col("_high"), "construction mismatch"),
        F.when((F.col("_driven") > 0) & (F.col("_most") < F.col("_driven")), "no shared drive-wheel intersection"),
        F.when(F.col("_spread") > SPREAD, "wheelbase spread exceeds 1.0 in"),
        F.when(F.col("_apart"), "no production-year overlap"),
    ]
    return rows.select("cluster_id", "members", F.concat_ws("; ", *reasons).alias("reasons"))


def flagged(checks: DataFrame) -> DataFrame:
    return checks.filter("reasons <> ''")


def apply_flags(membership: DataFrame, flags: DataFrame, earlier: DataFrame, scope: str = "structural", plain: str = "edc") -> DataFrame:
    """Confidence after a check: earlier flags go back to plain, then members of flagged clusters are marked."""
    marked = f"{plain}-flagged"
    now = flags.select("cluster_id", F.lit(True).alias("_now")).distinct()
    before = earlier.select("cluster_id", F.lit(True).alias("_before")).distinct()
    rows = membership.join(now, "cluster_id", "left").join(before, "cluster_id", "left")
    own = F.col("scope") == scope
    reverted = F.when(own & F.col("_before") & (F.col("confidence") == marked), plain).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", reverted).withColumn("confidence", F.when(own & F.col("_now") & (F.col("confidence") == plain), marked).otherwise(F.col("confidence"))).select(*membership.columns)


def verdicts(flags: DataFrame, date: Column) -> DataFrame:
    return flags.select(date.cast("string").alias("date"), F.lit("cluster").alias("part"), F.lit(METHOD).alias("method"), "cluster_id", F.lit("flag").alias("result"), F.col("reasons").alias("notes"))


def verdict_report(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "cluster_id", "result").agg(F.count("*").alias("n")).orderBy("method", "cluster_id", "result")


TUPLE = ["make", "model", "styles", "year_start", "year_end", "cluster_id"]


def validate(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, log: DataFrame, date: Column, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership and verdict log after a check of all structural clusters; earlier flags are replaced. Members that occur twice are refused."""
    twice = duplicate_tuples(membership, vehicles, TUPLE, tasks).count()
    if twice:
        raise ValueError(f"{twice} combinations of vehicle and cluster occur more than once")
    structural = clusters.filter("type = 'structural'").select("cluster_id")
    members = membership.join(structural, "cluster_id", "left_semi").join(vehicles, membership["vehicle_id"] == vehicles["id"])
    flags = flagged(consistency(members))
    old = (F.col("method") == METHOD) & (F.col("result") == "flag")
    return apply_flags(membership, flags, log.filter(old)), log.filter(~old).unionByName(verdicts(flags, date), allowMissingColumns=True)


def summary(clusters: DataFrame, membership: DataFrame, log: DataFrame) -> DataFrame:
    """One row of a validation's result: structural_clusters, flagged_clusters, verdict_rows."""
    flags = log.filter((F.col("method") == METHOD) & (F.col("result") == "flag"))
    counts = flags.agg(F.count_distinct("cluster_id").alias("flagged_clusters"), F.count("*").alias("verdict_rows"))
    total = clusters.agg(F.count_if(F.col("type") == "structural").alias("structural_clusters"))
    return total.join(F.broadcast(counts)).select("structural_clusters", "flagged_clusters", "verdict_rows")


def parse_gate(counts: DataFrame, most_skipped: float = 0.01, least_unique: int = 1800) -> DataFrame:
    """counts (raw, skipped, unique) with skipped_ratio and why a parse must not go on; null if it may."""
    ratio = F.col("skipped") / F.greatest(F.col("raw"), F.lit(1))
    problem = F.when(ratio > most_skipped, "too many rows skipped").when(F.col("unique") < least_unique, "too few vehicles")
    return counts.withColumns({"skipped_ratio": ratio, "problem": problem})

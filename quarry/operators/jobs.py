"""Planning of generation jobs: targets, what is still to do, cost, and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col, cost, slug, year_label

from .merge import first_labels, insert_or_replace, placed
from .shared import fresh

PLANNED_OUTPUT, MOST_OUTPUT, SIBLINGS = 3500, 8000, 8


#: Kinds of results.
RESULTS = ["ok", "max_tokens", "refusal", "errored", "canceled", "expired"]


def custom_id(cluster: Column | str, job: Column | str) -> Column:
    """At most 51 characters: the cluster's slug and ten hex digits of the hash of cluster and job."""
    digest = F.substring(F.sha2(F.concat(col(cluster), F.lit("|"), col(job)), 256), 1, 10)
    return F.concat(F.substring(slug(cluster, "-"), 1, 40), F.lit("_"), digest)


def targets(flat: DataFrame, jobs: DataFrame, scopes: list[str], clusters: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """scope, cluster_id, job, ord, labels, custom_id; tasks: as first_labels has it. flat has ord next to a flat export's columns; jobs has scope, job, ord."""
    rows = flat.filter(F.col("scope").isin(scopes) & (F.coalesce("cluster_id", F.lit("")) != ""))
    if clusters:
        rows = rows.filter(F.col("cluster_id").isin(clusters))
    rows = rows.withColumn("label", year_label("year_start", "year_end", "make", "model", "note"))
    groups = first_labels(rows, ["scope", "cluster_id"], "label", "ord", SIBLINGS, tasks)
    return groups.join(jobs.withColumnRenamed("ord", "job_ord"), "scope").withColumn("custom_id", custom_id("cluster_id", "job"))


def pending(rows: DataFrame, done: DataFrame, requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Targets without a finished result and without a request in an open batch."""
    flying = requests.join(batches.filter("status <> 'ended'").select("batch_id"), "batch_id", "left_semi").select("custom_id")
    return rows.join(done.filter("status = 'ok'").select("custom_id").union(flying).distinct(), "custom_id", "left_anti")


def plan(rows: DataFrame, prompt: Column, price_in: float, price_out: float) -> DataFrame:
    """One row: requests, clusters, expected and worst cost of a batch in US dollars."""
    facts = rows.agg(F.count("*").alias("requests"), F.count_distinct("scope", "cluster_id").alias("clusters"), F.coalesce(F.sum(F.floor(F.length(prompt) / 4)), F.lit(0)).alias("tokens_in"))
    money = lambda each: F.round(cost(F.col("tokens_in"), F.col("requests") * each, price_in, price_out), 2)
    return facts.withColumns({"est_cost": money(PLANNED_OUTPUT), "worst_cost": money(MOST_OUTPUT)})


def result_rows(results: DataFrame, requests: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Results of a batch with what was asked; ok only for a message that ended by itself."""
    status = F.when(F.col("type") != "succeeded", F.col("type")).when(F.col("message.stop_reason") == "end_turn", "ok").otherwise(F.col("message.stop_reason"))
    rows = results.join(requests, "custom_id")
    used = [F.coalesce(F.col(f"message.{c}"), F.lit(0)) for c in ("input_tokens", "output_tokens")]
    return rows.select("custom_id", "batch_id", "cluster_id", "scope", "job", status.alias("status"), F.col("message.text").alias("content"), used[0].alias("input_tokens"), used[1].alias("output_tokens"), cost(used[0], used[1], price_in, price_out).alias("cost_usd"))


def collect_results(stored: DataFrame, new: DataFrame, latest: list[Column | str]) -> DataFrame:
    return insert_or_replace(stored, new, ["custom_id"], latest)


def batch_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def batch_counters(rows: DataFrame) -> DataFrame:
    """A row per batch with a column for each kind of result: how many there are, and what they cost; other kinds count as other."""
    kind = F.when(F.col("status").isin(RESULTS), F.col("status")).otherwise("other")
    wide = rows.withColumn("kind", kind).groupBy("batch_id").pivot("kind", [*RESULTS, "other"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    return wide.na.fill(0)


def spread_sample(rows: DataFrame, limit: int) -> DataFrame:
    """Every n-th target in order, at most limit."""
    step = max(1, rows.count() // max(1, limit))
    (place,) = fresh(rows, "_place")
    own = placed(rows, ["scope", "cluster_id", "job_ord"], place)
    return own.filter((F.col(place) % step == 0) & (F.col(place) < step * limit)).drop(place)

"""Sibling pools: subjects, the clusters they belong to, and who else belongs to them.

Tables: vehicles (id, make, model, styles, year_start, year_end), clusters (cluster_id, type, label) and
membership (vehicle_id, cluster_id, scope, confidence, note). A whole lookup is one lazy plan of
equi-joins, so nothing goes by way of the driver and no join lacks a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.matching import model_matches, norm_make
from quarry.functions.text import tags

from .shared import fresh, written

#: As many of the subjects' clusters are sent to every task; more are joined by Spark's own choice.
FEW_CLUSTERS = 500_000


def subjects(vehicles: DataFrame, make: str, model: str, year: int, separators: bool = False) -> DataFrame:
    """Vehicles that a make, model and year can mean."""
    wanted = norm_make(F.lit(make)) if separators else F.lower(F.lit(make))
    return vehicles.filter((F.lower("make") == wanted) & F.lit(year).between(F.col("year_start"), F.col("year_end")) & model_matches(F.lit(model), "model", separators))


def bucket(kind: Column) -> Column:
    return F.when(kind == "structural", "structural").otherwise("engine_family")


def keep_first(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order; rows that tie in all of it are alike in what is kept."""
    (place,) = fresh(rows, "_place")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def sibling_pool(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, found: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Members of the subjects' clusters without the subjects, once for each bucket, make, model and note.

    The survivor is the first by type, cluster, make, model, first year and id.
    """
    ids = found.select(F.col("id").alias("vehicle_id"))
    shared = written(membership.join(ids, "vehicle_id", "left_semi").select("cluster_id").distinct(), "shared")
    if shared.count() <= FEW_CLUSTERS:  # then members stay dealt out by vehicle
        shared = F.broadcast(shared)
    peers = membership.join(shared, "cluster_id", "left_semi").join(ids, "vehicle_id", "left_anti")
    rows = peers.join(vehicles, peers["vehicle_id"] == vehicles["id"]).join(clusters.select("cluster_id", "type", "label"), "cluster_id")
    rows = rows.withColumns({"note": F.coalesce("note", F.lit("")), "label": F.coalesce("label", F.lit("")), "bucket": F.col("type") if case_sensitive else bucket(F.col("type"))})
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    order = ["type", "cluster_id", "year_start", "id"]  # make and model in lower case are one in each key
    return keep_first(rows, ["bucket", fold("make"), fold("model"), fold("note")], order).select("bucket", "cluster_id", "make", "model", "styles", "year_start", "year_end", "confidence", "note", "label")


def donor_pool(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, make: str, model: str, year: int, separators: bool = False) -> DataFrame:
    return sibling_pool(vehicles, clusters, membership, subjects(vehicles, make, model, year, separators), case_sensitive=separators)


def qualifier(note: Column, label: Column) -> Column:
    return F.coalesce(F.nullif(note, F.lit("")), F.nullif(label, F.lit("")), F.lit("—"))


def pool_lines(pool: DataFrame) -> DataFrame:
    """A line of text per sibling."""
    note = F.when(F.col("note") != "", F.concat(F.lit(" — "), F.col("note"))).otherwise("")
    line = F.concat(F.lit("  - "), F.concat_ws(" ", "make", "model", "styles"), F.lit(" "), F.col("year_start").cast("string"), F.lit("-"), F.col("year_end").cast("string"), F.lit(" ["), F.upper("confidence"), F.lit("]"), note)
    return pool.select("bucket", "cluster_id", "make", "model", line.alias("line"))


def rule_links(vehicles: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule × vehicle matches: same make, model like the pattern in any case, overlapping years.

    rules: rule_id, cluster_id, make, model_like, year_from, year_to, note. The make is the hash key; the
    pattern and the years are residual conditions.
    """
    v = vehicles.select(F.col("id").alias("vehicle_id"), F.col("make").alias("_make"), "model", "year_start", "year_end")
    hit = (F.col("_make") == F.col("make")) & F.expr("model ilike model_like") & (F.col("year_start") <= F.col("year_to")) & (F.col("year_end") >= F.col("year_from"))
    return rules.join(v, hit).select("rule_id", "vehicle_id", "cluster_id", "note")


def empty_rules(rules: DataFrame, links: DataFrame) -> DataFrame:
    return rules.join(links.select("rule_id").distinct(), "rule_id", "left_anti")


def unknown_references(references: DataFrame, clusters: DataFrame) -> DataFrame:
    return references.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_anti")


def tag_members(vehicles: DataFrame, column: str, scope: str) -> DataFrame:
    """Edges out of a column of `cluster:note;cluster:note` tags."""
    rows = vehicles.select("id", F.explode(tags(column)).alias("tag"))
    return rows.select(F.col("id").alias("vehicle_id"), F.col("tag.id").alias("cluster_id"), F.lit(scope).alias("scope"), F.col("tag.note").alias("note"))


def apply_overlay(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, new_vehicles: DataFrame, new_clusters: DataFrame, rules: DataFrame, tier: str = "compiled", first_id: int = 900_001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace a tier: its old rows go, its clusters win over others, its vehicles, tags and rules add edges.

    new_vehicles has ord (its order), platform and engines next to a vehicle's columns. Applying it twice
    gives the same tables.
    """
    known = new_clusters.select("cluster_id", "type", "label", F.lit(tier).alias("source"))
    kept = clusters.filter(F.col("source") != tier).join(known, "cluster_id", "left_anti")
    base = vehicles.filter(F.col("source") != tier)
    added = new_vehicles.withColumns({"id": (F.lit(first_id) + F.col("ord")).cast("long"), "source": F.lit(tier)})
    edges = tag_members(added, "platform", "platform").unionByName(tag_members(added, "engines", "engine-loop"))
    edges = edges.unionByName(rule_links(base, rules).select("vehicle_id", "cluster_id", F.lit("engine-loop").alias("scope"), "note"))
    edges = edges.join(known.select("cluster_id"), "cluster_id", "left_semi").withColumn("confidence", F.lit(tier))
    return (
        base.unionByName(added.select(*base.columns), allowMissingColumns=True),
        kept.unionByName(known),
        membership.filter(F.col("confidence") != tier).unionByName(edges.select("vehicle_id", "cluster_id", "scope", "confidence", "note")),
    )


def apply_curated(membership: DataFrame, curated: DataFrame) -> tuple[DataFrame, int]:
    """Membership with its curated tier replaced by curated (vehicle_id, cluster_id, scope, note), each edge once, and how many edges that tier now has."""
    new = curated.dropDuplicates(["vehicle_id", "cluster_id", "scope"]).withColumn("confidence", F.lit("curated")).select(*membership.columns)
    return membership.filter(~F.coalesce(F.col("confidence") == "curated", F.lit(False))).unionByName(new), new.count()

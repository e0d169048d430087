"""Vehicle tables out of text that kept its page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The layout's line forms.
ROW = r"^(.*?)\s+([fu](?:/[fu])?)\s+(,?[fr4a](?:\s*[,/]\s*[fr4a])*)\s+(\d{4})\s+(\d{4})(.*)$"
WHEELBASE = r"^[\d.]+(,[\d.]+)*$"
SECTION_LINE, PAGE_LINE = r"^\s+\d{4}\s+All Cars", r"^\s*Page \d+\s*$"
MAKE_INDENT, DOUBTFUL = 10, 25


def layout_lines(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """key, page, line, words, and the column of REMARKS by the last header line (pages do not reset it)."""
    pages = texts.select(key, F.posexplode(F.split(text, "\f")).alias("page", "body"))
    lines = pages.select(key, "page", F.posexplode(F.split("body", "\n")).alias("line", "words")).filter(F.btrim("words") != "")
    lines = lines.filter(~F.col("words").rlike(PAGE_LINE) & ~F.col("words").rlike(SECTION_LINE))
    head = F.contains("words", F.lit("MAKE")) & F.contains("words", F.lit("MODEL")) & F.contains("words", F.lit("STYLES"))
    over = Window.partitionBy(key).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"_head": head, "remarks_at": F.last(F.when(head, F.instr("words", "REMARKS") - 1), ignorenulls=True).over(over)})
    return lines.filter("not _head").drop("_head")


def vehicle_rows(texts: DataFrame, key: str = "file", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Vehicles in order of appearance, and lines that look like rows but are none."""
    lines = layout_lines(texts, key, text)
    part = lambda i: F.regexp_extract("words", ROW, i)
    skipped = lines.filter(~F.col("words").rlike(ROW) & (F.length(F.btrim("words")) > DOUBTFUL) & F.col("words").rlike(r"\d{4}\s+\d{4}"))
    rows = lines.filter(F.col("words").rlike(ROW))
    indent = F.length("words") - F.length(F.ltrim("words"))
    words = F.split(F.btrim(part(1)), r"\s{2,}")
    has_make = (indent <= MAKE_INDENT) & (F.size(words) >= 2)
    rest = F.when(has_make, F.slice(words, 2, F.size(words))).otherwise(words)
    rows = rows.withColumns({"make": F.when(has_make, words[0]).otherwise(""), "_rest": rest, "tail": part(6)})
    last = F.try_element_at("_rest", F.lit(-1))
    based = (F.size("_rest") >= 2) & last.rlike(WHEELBASE)
    cluster = F.nullif(F.regexp_extract("tail", r"(\d{6})\s*$", 1), F.lit(""))
    body = F.when(cluster.isNotNull(), F.regexp_replace("tail", r"\d{6}\s*$", "")).otherwise(F.col("tail"))
    cut = F.col("remarks_at") - (F.length("words") - F.length("tail"))
    split = (F.col("remarks_at") > 0) & (cut > 0) & (cut < F.length(body))
    rows = rows.select(
        key, "page", "line", "make", F.coalesce(F.try_element_at("_rest", F.lit(1)), F.lit("")).alias("model"),
        F.when(F.size("_rest") < 2, "").otherwise(F.array_join(F.slice("_rest", F.lit(2), F.greatest(F.lit(0), F.size("_rest") - F.when(based, 2).otherwise(1))), " ")).alias("styles"),
        F.when(based, last).otherwise("").alias("wheelbase"), part(2).alias("construction"), F.regexp_replace(part(3), r"\s+", "").alias("drive"),
        part(4).cast("int").alias("year_start"), part(5).cast("int").alias("year_end"),
        F.btrim(F.when(split, F.substring(body, F.lit(1), cut)).otherwise(body)).alias("alt_models"), F.btrim(F.when(split, F.substring(body, cut + 1, F.length(body))).otherwise("")).alias("remarks"), cluster.alias("cluster_id"),
    )
    over = Window.partitionBy(key).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("make", F.last(F.nullif("make", F.lit("")), ignorenulls=True).over(over)), skipped


def distinct_vehicles(rows: DataFrame, key: str = "file") -> DataFrame:
    """The first of rows that agree in make, model, styles, years and cluster."""
    same = ["make", "model", "styles", "year_start", "year_end", "cluster_id"]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(key, "page", "line"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def parse_stats(rows: DataFrame, skipped: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: raw, skipped, unique, clusters, and the share of skipped lines."""
    raw = rows.agg(F.count("*").alias("raw"))
    left = skipped.agg(F.count("*").alias("skipped"))
    kept = unique.agg(F.count("*").alias("unique"), F.count_distinct("cluster_id").alias("clusters"))
    return raw.join(left).join(kept).withColumn("skipped_ratio", F.col("skipped") / F.greatest(F.col("raw"), F.lit(1)))

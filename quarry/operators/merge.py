"""Inserts, upserts and tier replacement as functions of whole tables, and ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pool import keep_first
from .shared import dealt, fresh, written


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows whose key is taken are left out, and of new rows with one key the first stays."""
    return existing.unionByName(keep_first(new.join(existing.select(*keys), keys, "left_anti"), keys, order).select(*existing.columns))


def insert_or_replace(existing: DataFrame, new: DataFrame, keys: list[str], latest: list[Column | str]) -> DataFrame:
    """New rows win over existing ones, and of new rows with one key the first in the order latest."""
    newest = keep_first(new, keys, latest).select(*existing.columns)
    return existing.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def replace_tier(existing: DataFrame, new: DataFrame, old: Column) -> DataFrame:
    """What the condition names goes, the new rows come."""
    return existing.filter(~F.coalesce(old, F.lit(False))).unionByName(new.select(*existing.columns))


def reload_tiers(new: DataFrame, path: str, tier: str, tiers: list[str]) -> None:
    """Replace some tiers of a table that is partitioned by tier, and leave the files of the others as they are.

    Partitions of new are overwritten one by one; a tier of the list without new rows loses its own. Rows of a tier
    that is not listed are refused before anything is written.
    """
    spark = new.sparkSession
    own = written(new, "tier")
    found = {r[0] for r in own.select(tier).distinct().limit(len(tiers) + 1).collect()}
    if not found <= set(tiers):
        raise ValueError(f"rows of other tiers than {', '.join(tiers)}")
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tier).parquet(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in set(tiers) - found:
        fs.delete(root.suffix(f"/{tier}={escape(name)}"), True)


def placed(rows: DataFrame, order: list[Column | str], column: str = "_place") -> DataFrame:
    """rows with a new column, their places from 0 in a stated order, as a table in the shared folder.

    The rows are brought into ascending ranges and written once, each with its range and its place there;
    counts of ranges give the bases. No task ranks the whole table, and every later step reads the same
    ranges. Rows that tie in the order follow their other columns, so that only equal rows are interchangeable.
    """
    if fresh(rows, column) != [column]:
        raise ValueError(f"there is a column {column} already")
    part, at, base, own = fresh(rows, "_part", "_at", "_base", "_own")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {x for x in order if isinstance(x, str)}
    order = [*(F.col(f"`{x}`") if isinstance(x, str) and x in rows.columns else x for x in order), *(F.col(f"`{f.name}`") for f in rows.schema if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType)))]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    before = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = ranged.groupBy(F.col(part).alias(own)).agg(F.count("*").alias(base)).select(own, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    # as many rows as ranges, a setting of the session
    return ranged.join(F.broadcast(bases), F.col(part) == F.col(own)).withColumn(column, F.col(base) + F.col(at)).drop(part, at, base, own)


def numbered(rows: DataFrame, order: list[Column | str], first: int = 1, column: str = "id") -> DataFrame:
    """Ids from first on in a stated order, without a gap, as a new column."""
    found = placed(rows, order, column)
    return found.withColumn(column, F.col(f"`{column}`") + first)


def carry_forward(rows: DataFrame, column: str, by: list[str], order: list[Column | str]) -> DataFrame:
    """The last value that is not blank, for rows that have none."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(column, F.lit("")), ignorenulls=True).over(over))


def stride_sample(rows: DataFrame, by: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """Of each group every n-th row, n so that about limit rows span the group, and no more than limit.

    Places in the group come from places in the whole table, so that no task holds a group.
    """
    place, first, n, *keys = fresh(rows, "_place", "_first", "_n", *(f"_by{i}" for i in range(len(by))))
    own = placed(rows, [*by, *order], place)
    groups = own.groupBy(*(F.col(c).alias(k) for k, c in zip(keys, by))).agg(F.min(place).alias(first), F.count("*").alias(n))
    joined = own.join(groups, [F.col(c).eqNullSafe(F.col(k)) for k, c in zip(keys, by)])
    nth, step = F.col(place) - F.col(first), F.greatest(F.lit(1), F.floor(F.col(n) / limit))
    return joined.filter((nth % step == 0) & (nth < step * limit)).select(*(F.col(f"`{c}`") for c in rows.columns))


def first_labels(rows: DataFrame, by: list[str], label: str, order: Column | str, limit: int = 8, tasks: int | None = None) -> DataFrame:
    """The first distinct labels of each group, in order of first mention, as an array of at most limit.

    With a number of tasks the rows are dealt out among these by group once, for all that follows.
    """
    rows = dealt(rows, tasks, *by)
    at, nth = fresh(rows, "_at", "_place")
    firsts = rows.groupBy(*by, label).agg(F.min(order).alias(at))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at, label))
    few = firsts.withColumn(nth, place).filter(F.col(nth) <= limit)
    return few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(nth, label))), lambda x: x[label]).alias("labels"))


def best_unless_tied(scores: DataFrame, by: list[str], score: str, candidate: str, current: str) -> DataFrame:
    """The best candidate of each group; none where the runner-up ties and the best is not the current one."""
    over = Window.partitionBy(*by).orderBy(F.desc(score), F.desc(candidate))
    place, following = fresh(scores, "_place", "_next")
    rows = scores.withColumns({place: F.row_number().over(over), following: F.lead(score).over(over)}).filter(F.col(place) == 1)
    tied = F.coalesce(F.col(following) == F.col(score), F.lit(False)) & ~F.coalesce(F.col(candidate) == F.col(current), F.lit(False))
    return rows.filter((F.col(score) >= 0) & ~tied).drop(place, following)

"""Requests cut into batches of bounded rows and bytes, and a table of what has been sent, so that nothing is sent twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import pending
from .merge import numbered, placed
from .shared import fresh, written

#: Rows of a block of prefix sums: one task sums a block, and the blocks' sums are few.
BLOCK = 4096


def cut(requests: DataFrame, order: list[Column | str], max_rows: int, max_bytes: int, value: str = "value", first: int = 1) -> DataFrame:
    """requests with batch: numbers from first on without a gap, in the stated order.

    Prefix sums over ranges give each request its place and the bytes before it. Requests above half of max_bytes are
    batches by themselves; the others fall into windows of rows and of as many bytes as leave room for the largest of
    them, so no batch passes either bound and no task walks all requests. A request above max_bytes is refused.
    """
    place, size, block, before, large, cell, row_cell, number = fresh(requests, "_place", "_size", "_block", "_before", "_large", "_cell", "_rows", "batch")
    if number != "batch":
        raise ValueError("there is a column batch already")
    own = requests.withColumn(size, F.octet_length(F.col(value)).cast("long")).withColumn(large, F.coalesce(F.col(size) * 2 > max_bytes, F.lit(False)))
    most, room = own.agg(F.max(size), F.max(F.when(~F.col(large), F.col(size)))).first()
    if (most or 0) > max_bytes:
        raise ValueError(f"a request of {most} bytes is larger than a batch")
    rows = placed(own, [large, *order], place).withColumn(block, F.floor(F.col(place) / BLOCK))
    within = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(block).alias("b")).agg(F.sum(size).alias("s"))
    sums = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))  # a row per block
    rows = rows.withColumn(before, F.coalesce(F.sum(size).over(within), F.lit(0))).join(sums, F.col(block) == F.col("b")).withColumn(before, F.col(before) + F.col("s")).drop("b", "s")
    width = max(1, max_bytes - (room or 0))
    rows = rows.withColumns({
        row_cell: F.when(F.col(large), F.col(place)).otherwise(F.floor(F.col(place) / max_rows)), cell: F.when(F.col(large), F.lit(0)).otherwise(F.floor(F.col(before) / width)),
    })
    rows = written(rows, "cut")
    cells = numbered(rows.select(F.col(large).alias("l"), F.col(row_cell).alias("r"), F.col(cell).alias("c")).distinct(), ["l", "r", "c"], first, "batch")
    found = rows.join(cells, (F.col(large) == F.col("l")) & (F.col(row_cell) == F.col("r")) & (F.col(cell) == F.col("c")))
    return found.select(*(F.col(f"`{c}`") for c in requests.columns), "batch")


def submit(targets: DataFrame, done: DataFrame, sent: DataFrame, batches: DataFrame, order: list[Column | str], max_rows: int, max_bytes: int, value: str = "value") -> DataFrame:
    """The targets that are neither finished nor under way, cut into batches behind those there are.

    sent: custom_id, batch_id; batches: batch_id, status (ended or another); done: custom_id, status. What failed in an
    ended batch is sent again.
    """
    last = batches.agg(F.max("batch_id")).first()[0] or 0
    return cut(pending(targets, done, sent, batches), order, max_rows, max_bytes, value, last + 1)


def opened(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sent, batches) of what submit() gave, to be appended to the state: batches are open until they are marked as ended."""
    sent = found.select("custom_id", F.col("batch").alias("batch_id"))
    return sent, found.groupBy(F.col("batch").alias("batch_id")).agg(F.count("*").alias("requests")).withColumn("status", F.lit("open"))

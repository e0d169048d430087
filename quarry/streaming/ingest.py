"""Ingest as a stream: files as they arrive, upserted into kept tables and a kept index, each batch once.

Below a root folder, files/segment=B, chunks/segment=B, specs/segment=B and report/segment=B hold what batch B gave, and
index/ its segment of postings. A batch counts once done/B is there, which is written last and by renaming. A batch
that broke before is run again by the stream under the same number and writes the same segments again; one that
counts already is left alone. Of a path, the segment of its newest file counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import inverted
from quarry.operators.retrieval import chunks as cut_chunks
from quarry.sources.documents import CHUNK_ROWS, FILE_ROWS, SPEC_ROWS, Knowledge, parsed, pdf_pages

TABLES = {"files": FILE_ROWS, "chunks": CHUNK_ROWS, "specs": SPEC_ROWS}
REPORT = "path string, reason string, pages long, chunks long, spec_rows long, skipped_rows long"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that count."""
    folder, fs = _path(spark, f"{root}/done")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _segments(spark: SparkSession, root: str, name: str, schema: str, numbers: list[int]) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], f"{schema}, segment long")
    return spark.read.schema(f"{schema}, segment long").option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/segment={n}" for n in numbers))


def knowledge(spark: SparkSession, root: str) -> Knowledge:
    """What all batches that count have left: of each path the rows of its newest segment."""
    numbers = batches(spark, root)
    every = {name: _segments(spark, root, name, schema, numbers) for name, schema in TABLES.items()}
    newest = every["files"].groupBy("path").agg(F.max("segment").alias("segment"))
    return Knowledge(*(rows.join(newest, ["path", "segment"], "left_semi").drop("segment") for rows in every.values()))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """The reports of all batches that count, with their segment."""
    return _segments(spark, root, "report", REPORT, batches(spark, root))


def upsert(files: DataFrame, number: int, root: str, extract: Callable[[bytes], list[str]] = pdf_pages, chunk: Callable[[DataFrame], DataFrame] = cut_chunks, index: bool = True) -> None:
    """Write what a batch of files (documents.FILES) gives as segment number, unless that counts already."""
    spark = files.sparkSession
    if number in batches(spark, root):
        return
    fresh, report = parsed(files, knowledge(spark, root), extract, chunk)
    for name, rows in zip(TABLES, fresh):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/segment={number}")
    report.write.mode("overwrite").parquet(f"{root}/report/segment={number}")
    if index:
        new = spark.read.schema(CHUNK_ROWS).parquet(f"{root}/chunks/segment={number}")
        done = spark.read.schema(FILE_ROWS).parquet(f"{root}/files/segment={number}").select("path")
        row = F.concat_ws("\n", "path", F.col("place").cast("string"), F.col("ord").cast("string"))
        inverted.add(new.withColumn("row", row), f"{root}/index", "path", "row", ["text", "section"], gone=done, stem=True, number=number + 1)
    begun, fs = _path(spark, f"{root}/done/.{number}")
    fs.create(begun, True).close()
    fs.rename(begun, _path(spark, f"{root}/done/{number}")[0])


def ingest_stream(files: DataFrame, root: str, checkpoint: str, first: int = 0, **how):
    """Upsert a stream of files (documents.FILES), for what has arrived by now; its batches are numbered from first on."""
    own = files.writeStream.foreachBatch(lambda batch, number: upsert(batch, first + number, root, **how))
    return own.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""A kept inverted index: segments of postings in buckets of terms, delete marks, merging, and BM25 over what is live.

Below a root folder, postings/segment=S/bucket=B holds term, owner, row, tf and length; rows/segment=S owner, row and
length; gone/segment=S the owners whose rows in earlier segments are dead. A segment counts once done/S is there, a file
that is written beside and renamed, so a run that breaks leaves nothing that readers see, and the same segment can be
written again. Owners (files) are what is replaced; rows are their chunks. A merge writes what is live as one segment
that names those it replaces. One writer at a time; readers keep the segments that they began with, until vacuum().

A search reads the postings of the buckets of its terms only: bucket is a partition of the table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stemming import term_counts
from quarry.functions.text import col

from .retrieval import asked_terms, scored, terms
from .shared import written

BUCKETS = 256
#: Terms of texts in a bucket for each task that writes it: one common term is no task's alone, and small segments have few files.
SALTED, MOST_SALTS = 100_000, 256


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def segments(spark: SparkSession, root: str) -> dict[int, dict]:
    """Number -> what done/S says (rows, gone, stem, replaces), of the segments that count."""
    folder, fs = _path(spark, f"{root}/done")
    names = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    names = [n for n in names if n.rpartition("/")[2].isdigit()]
    found = {r["number"]: r for r in (json.loads(r[0]) for r in spark.read.text(names).collect())} if names else {}  # a line a segment
    replaced = {n for r in found.values() for n in r["replaces"]}
    return {n: r for n, r in sorted(found.items()) if n not in replaced}


def _read(spark: SparkSession, root: str, kind: str, numbers: list[int], schema: str) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*(f"{root}/{kind}/segment={n}" for n in numbers))


def _rows(spark: SparkSession, root: str, known: dict[int, dict], kind: str, columns: str) -> DataFrame:
    """All rows of the segments with their number, dead ones too."""
    return _read(spark, root, kind, [n for n, r in known.items() if r["gone" if kind == "gone" else "rows"]], columns + ", segment long")


def _live(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of segments that no later segment has marked."""
    last = marks.groupBy(F.col("owner").alias("marked")).agg(F.max("segment").alias("last"))
    return rows.join(last, F.col("owner") == F.col("marked"), "left").filter(F.col("last").isNull() | (F.col("segment") >= F.col("last"))).drop("marked", "last")


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(col(term)), F.lit(BUCKETS)).cast("int")


def _write(spark: SparkSession, root: str, number: int, postings: DataFrame, rows: DataFrame, gone: DataFrame, stem: bool, replaces: list[int]) -> None:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_terms = rows.agg(F.sum("length")).first()[0] or 0
    salts = max(1, min(MOST_SALTS, n_terms // (BUCKETS * SALTED)))
    spread = postings.withColumn("bucket", _bucket("term")).repartition(parts, "bucket", F.pmod(F.xxhash64("row"), F.lit(salts)))
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings/segment={number}")
    rows.write.mode("overwrite").parquet(f"{root}/rows/segment={number}")
    gone.write.mode("overwrite").parquet(f"{root}/gone/segment={number}")
    sizes = [spark.read.schema("owner string").parquet(f"{root}/{kind}/segment={number}").count() for kind in ("rows", "gone")]
    told = json.dumps({"number": number, "rows": sizes[0], "gone": sizes[1], "stem": stem, "replaces": replaces})
    path, fs = _path(spark, f"{root}/done/.{number}")
    with_name, _ = _path(spark, f"{root}/done/{number}")
    out = fs.create(path, True)
    out.write(bytearray(told.encode()))
    out.close()
    if not fs.rename(path, with_name):
        raise RuntimeError(f"segment {number} is there already")


def add(rows: DataFrame, root: str, owner: str, row: str, text: Column | str | list[str], gone: DataFrame | None = None, stem: bool = False, number: int | None = None) -> int:
    """Write rows as a segment, in place of all that their owners had, and drop the owners of gone; returns its number.

    text may be several columns that count as one. With stem the index holds folded stems. A row's terms
    are counted where it is read, so only postings are moved, and once. number: a number of the caller's, above those there are; a segment that counts already is left alone.
    """
    spark = rows.sparkSession
    known = segments(spark, root)
    if number in known:
        return number
    number = max(known, default=0) + 1 if number is None else number
    if number <= max(known, default=0) or any(r["stem"] != stem for r in known.values()):
        raise ValueError("numbers ascend, and an index holds stems or forms")
    text = F.concat_ws(" ", *text) if isinstance(text, list) else col(text)
    own = rows.select(F.col(owner).cast("string").alias("owner"), F.col(row).cast("string").alias("row"), terms(F.coalesce(text, F.lit(""))).alias("terms"))
    own = written(own.select("owner", "row", F.size("terms").cast("long").alias("length"), term_counts("terms", stem).alias("counts")), "index-rows")
    postings = own.select("owner", "row", "length", F.inline("counts")).select("term", "owner", "row", "length", "tf")
    named = own.select("owner")
    if gone is not None:
        named = named.unionByName(gone.select(F.col(owner).cast("string").alias("owner")))
    before = _rows(spark, root, known, "rows", "owner string, row string, length long").select("owner").distinct()
    _write(spark, root, number, postings, own.select("owner", "row", "length"), named.distinct().join(before, "owner", "left_semi"), stem, [])
    return number


def merge(spark: SparkSession, root: str) -> int | None:
    """One segment of all that is live in place of those there are; its number, or None where there is nothing to merge."""
    known = segments(spark, root)
    if len(known) < 2:
        return None
    marks = written(_rows(spark, root, known, "gone", "owner string"), "marks")
    postings = _live(_rows(spark, root, known, "postings", "term string, owner string, row string, length long, tf long"), marks).drop("segment")
    rows = _live(_rows(spark, root, known, "rows", "owner string, row string, length long"), marks).drop("segment")
    number = max(known) + 1
    _write(spark, root, number, postings, rows, spark.createDataFrame([], "owner string"), next(iter(known.values()))["stem"], list(known))
    return number


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the folders of segments that do not count any more; for when no reader is at them."""
    known = segments(spark, root)
    for kind in ("postings", "rows", "gone"):
        folder, fs = _path(spark, f"{root}/{kind}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if int(status.getPath().getName().partition("=")[2]) not in known:
                fs.delete(status.getPath(), True)


def postings_of(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """The live postings of asked terms (column term), from their buckets alone."""
    known = segments(spark, root)
    buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]  # at most BUCKETS
    rows = _rows(spark, root, known, "postings", "term string, owner string, row string, length long, tf long, bucket int")
    found = rows.filter(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")
    return _live(found, _rows(spark, root, known, "gone", "owner string"))


def search(queries: DataFrame, root: str, k: int | None = 4) -> DataFrame:
    """query_id, row, score and place of the k best live rows for each query (query_id, query), as retrieval.bm25 has them."""
    spark = queries.sparkSession
    known = segments(spark, root)
    asked = written(asked_terms(queries, any(r["stem"] for r in known.values())), "asked")
    rows = _live(_rows(spark, root, known, "rows", "owner string, row string, length long"), _rows(spark, root, known, "gone", "owner string"))
    total = rows.agg(F.count("*").alias("n_rows"), F.avg("length").alias("mean_length"))
    return scored(postings_of(spark, root, asked).select("term", "row", "tf", "length"), asked, total, "row", k)

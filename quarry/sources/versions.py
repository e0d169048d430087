"""Tables as versions: every commit is a new folder of whole tables, which counts once its marker is there."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

MARKER = "_TABLES"


def tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Name -> folder, by the newest finished version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getParent().getName() for s in fs.globStatus(path.suffix(f"/*/{MARKER}")) or []]
    return dict(r[0].split("\t", 1) for r in spark.read.text(f"{root.rstrip('/')}/{max(found)}/{MARKER}").collect() if r[0]) if found else {}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(tables(spark, root)[name])


def commit(spark: SparkSession, root: str, new: dict[str, DataFrame]) -> None:
    """Write new tables as the next version; those left out are carried over by name. Readers keep what they began with; of two writers at once the later folder counts."""
    folder = f"{root.rstrip('/')}/{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    known = tables(spark, root)
    for name, df in new.items():
        df.write.parquet(f"{folder}/{name}")
        known[name] = f"{folder}/{name}"
    lines = spark.createDataFrame([(f"{k}\t{v}",) for k, v in sorted(known.items())], "value string")
    lines.coalesce(1).write.text(f"{folder}/{MARKER}.new")
    # a marker has its name only when it is whole
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MARKER}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path.suffix(".new"), path)

"""Folders and intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, also set for checkpoint().

    Only a local session without one gets a temporary folder; on a cluster its files would be lost to others.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="quarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
        base = base if sc.getConf().get("spark.checkpoint.dir") else sc.getCheckpointDir()
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below checkpoint_dir; it goes when the session ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


#: About so many rows of a large table come to a task of a join or a grouping.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks so many rows are dealt out to, at least the session's number of partitions; None where one task can take all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)) if rows > ROWS_A_TASK else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt out by keys among so many tasks, which Spark does not put together again; as it is with None."""
    return df.repartition(tasks, *keys) if tasks else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

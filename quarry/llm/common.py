"""Tables, texts and files of the training-data operators, and what their workers keep."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import shared_dir, written

__all__ = ["delete_written", "filesystem", "free_shuffles", "partitions", "shared_dir", "table", "text_of", "texts_of", "worker_state", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_written(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's JVM collects what refers to them; between large steps this asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI in the shared folder, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_of(col: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


_state: dict[Hashable, object] = {}


def worker_state(key: Hashable = None, build: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps between tasks: one operator's tables at a time, so that stages that follow each other do not add up. Without build, nothing."""
    if key not in _state:
        _state.clear()
        if build is not None:
            _state[key] = build()
    return _state.get(key)


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of an Arrow column, few at a time as Python objects; null as empty."""
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).to_pylist():
            yield text or ""

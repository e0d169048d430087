"""Folders of documents as a Spark data source, "quarry-docs": in batches with pushed filters, and as a stream.

register(spark), then spark.read.format("quarry-docs").load(root) gives path (relative to root), suffix,
sha256, content and reason of every file below root, as documents.read_files does (but also of empty files and
those whose names begin with a point, which Spark's own scan leaves out), and readStream what is new or changed. Files are dealt to partitions of about PARTITION_BYTES. Options choose files before any
is opened: prefix (of the path) and suffixes (a list with commas). With the option pushFilters, conditions of a query on
path and suffix (equality, IN, prefix, ending) do so too; it is for a DataFrame that one query reads, since Spark keeps
what was pushed last for later queries on the same DataFrame that push nothing. Any file system that pyarrow has will
do; where a folder can be read by Spark alone, documents.read_files reads it.

A stream's offset is the time and path of the last file that was seen, so a file counts as new by its time of change.
A file that goes before it is read gives no row; a folder that is none gives one row that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .documents import FILES, PAGES, TABLES, TEXT

PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20


class File(NamedTuple):
    path: str
    size: int
    changed: int


class Group(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith(("/", "file:")):
        return pafs.LocalFileSystem(), "/" + root.removeprefix("file:").strip("/")
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


def suffix_of(path: str) -> str:
    """What stands behind the last point of a file's name, in lower case."""
    return path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""


def listed(root: str) -> list[File] | None:
    """The files below root by relative path; None if it is no folder."""
    fs, folder = _filesystem(root)
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return None
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
    return [File(f.path[len(folder) + 1 :], f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File]


def dealt(files: list[File], most: int) -> list[Group]:
    """Files in order of their paths, in groups of about most bytes."""
    groups, size = [], most
    for f in sorted(files):
        if size + f.size > most:
            groups.append([])
            size = 0
        groups[-1].append(f.path)
        size += f.size
    return [Group(g) for g in groups]


def read_group(root: str, paths: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of FILES, in batches of about BATCH_BYTES."""
    fs, folder = _filesystem(root)
    schema = pa.schema([("path", pa.string()), ("suffix", pa.string()), ("sha256", pa.string()), ("content", pa.binary()), ("reason", pa.string())])
    rows, size = [], 0
    for path in paths:
        try:
            with fs.open_input_stream(f"{folder}/{path}", compression=None) as f:
                content = f.read()
        except FileNotFoundError:
            continue
        suffix = suffix_of(path)
        reason = None if suffix in (*TEXT, *TABLES, *PAGES) else "unsupported type " + (f".{suffix}" if suffix else "(none)")
        rows.append((path, suffix, hashlib.sha256(content).hexdigest(), content, reason))
        size += len(content)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


class Reader(DataSourceReader):
    def __init__(self, root: str, most: int, wanted: list[tuple[str, str, object]]):
        self.root, self.most, self.wanted = root, most, wanted

    def wants(self, path: str) -> bool:
        """Whether a file meets all conditions; a comparison with null is met by none."""
        for kind, column, value in self.wanted:
            own = path if column == "path" else suffix_of(path)
            met = own == value if kind == "is" else own in value if kind == "in" else value is not None and (own.startswith(value) if kind == "starts" else own.endswith(value))
            if not met:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        files = listed(self.root)
        if files is None:
            return [Group([])] if not self.wanted else []
        return dealt([f for f in files if self.wants(f.path)], self.most)

    def read(self, partition: Group | None) -> Iterator:
        if partition is None:  # what Spark hands over where there are no partitions
            return
        if not partition.paths:
            yield (self.root, "", "", None, "not a directory")
        yield from read_group(self.root, partition.paths)


class PushingReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("path",), ("suffix",)):
                self.wanted.append((kinds[type(f)], f.attribute[0], f.value))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, most: int, wanted: list[tuple[str, str, object]]):
        self.root, self.most = root, most
        self.wants = Reader(root, most, wanted).wants

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.changed, f.path) for f in listed(self.root) or []), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((x["changed"], x["path"]) for x in (start, end))
        return dealt([f for f in listed(self.root) or [] if low < (f.changed, f.path) <= high and self.wants(f.path)], self.most)

    def read(self, partition: Group | None) -> Iterator:
        yield from read_group(self.root, partition.paths if partition else [])


class Docs(DataSource):
    """Options: path (the folder), prefix, suffixes, partitionBytes, pushFilters."""

    @classmethod
    def name(cls) -> str:
        return "quarry-docs"

    def schema(self) -> str:
        return FILES

    def _own(self) -> tuple[str, int, list[tuple[str, str, object]]]:
        wanted: list[tuple[str, str, object]] = [("starts", "path", self.options["prefix"])] if self.options.get("prefix") else []
        if self.options.get("suffixes"):
            wanted.append(("in", "suffix", tuple(x.strip().lower() for x in self.options["suffixes"].split(","))))
        return self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), wanted

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushFilters", "false").lower() == "true" else Reader)(*self._own())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(*self._own())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, which must push filters for those who ask for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Docs)

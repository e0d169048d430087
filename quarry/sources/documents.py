"""Folders of documents: sections and pages, spec tables, change detection by content hash, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import inverted
from quarry.operators.retrieval import CHARACTERS_AT_ONCE
from quarry.operators.retrieval import chunks as cut_chunks
from quarry.operators.shared import written

from .tables import ROWS_AT_ONCE, cells_of, specs_of_cells

TEXT, TABLES, PAGES = ("md", "txt"), ("csv", "xlsx"), ("pdf",)
HEADING = r"^#{1,6}\s+(.*\S)\s*$"
FILES = "path string, suffix string, sha256 string, content binary, reason string"
NO_TEXT = "no extractable text"
FILE_ROWS = "path string, sha256 string, pages long, chunks long, spec_rows long"
CHUNK_ROWS = "path string, page int, place long, section string, ord int, text string, sha256 string"
SPEC_ROWS = "path string, row long, make string, model string, year_start int, year_end int, ecu_family string, quantity string, value double, vmin double, vmax double, unit string, measurement_state string, page int, source_file string, spec_key string"


class Knowledge(NamedTuple):
    """The tables that an ingest keeps: files (FILE_ROWS), chunks (CHUNK_ROWS) and specs (SPEC_ROWS)."""

    files: DataFrame
    chunks: DataFrame
    specs: DataFrame


def no_knowledge(spark: SparkSession) -> Knowledge:
    return Knowledge(*(spark.createDataFrame([], x) for x in (FILE_ROWS, CHUNK_ROWS, SPEC_ROWS)))


def with_reasons(files: DataFrame) -> DataFrame:
    """path, suffix, sha256, content of files (path, content), and a reason for those of no known type."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~suffix.isin(*TEXT, *TABLES, *PAGES), F.concat(F.lit("unsupported type "), F.when(suffix == "", "(none)").otherwise(F.concat(F.lit("."), suffix))))
    return files.select("path", suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"), "content", reason.alias("reason"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """with_reasons for every file below a folder, by paths relative to it; if it is none, one row that says so."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(path) and fs.getFileStatus(path).isDirectory()):
        return spark.createDataFrame([(root, "", "", None, "not a directory")], FILES)
    base = fs.makeQualified(path).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return with_reasons(rows.select(F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("path"), "content"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files with a status against the known hashes (path, sha256): new, changed or unchanged."""
    rows = files.join(known.select("path", F.col("sha256").alias("known_sha")), "path", "left")
    return rows.withColumn("status", F.when(F.col("known_sha").isNull(), "new").when(F.col("known_sha") != F.col("sha256"), "changed").otherwise("unchanged")).drop("known_sha")


def sections(rows: DataFrame, key: str = "path", text: str = "text", headings: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns of keep, place, section, text: a text cut at its headings, where it is read. headings: a condition for rows that have any."""
    own = rows.select(key, *keep, F.expr(headings or "true").alias("_has"), F.split(F.col(text), r"\r\n|\r|\n").alias("_lines")).filter("_lines is not null")
    own = own.withColumn("_heads", F.when(F.col("_has"), F.transform("_lines", lambda x: F.nullif(F.regexp_extract(x, HEADING, 1), F.lit("")))))
    at = F.filter(F.transform("_heads", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    own = own.withColumn("_at", F.coalesce(at, F.array().cast("array<int>")))
    bounds = F.zip_with(F.concat(F.array(F.lit(-1)), "_at"), F.concat("_at", F.array(F.size("_lines"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    body = lambda x: strip(F.array_join(F.slice("_lines", x["a"] + 2, x["b"] - x["a"] - 1), "\n"))
    part = lambda x, i: F.struct(i.cast("long").alias("place"), F.coalesce(F.get("_heads", x["a"]), F.lit("")).alias("section"), body(x).alias("text"))
    return own.select(key, *keep, F.inline(F.transform(bounds, part))).filter("text <> ''")


def pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, sha256, page, text, error of paged files by an extractor that gives a text for each page. Pages count from 1; a file that cannot be read is one row with its error.

    About a million characters travel together, however large the batch that they came in.
    """
    schema = pa.schema({"path": pa.string(), "sha256": pa.string(), "page": pa.int32(), "text": pa.string(), "error": pa.string()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for path, sha256, content in zip(*part.columns):
                try:
                    texts, error = extract(content.as_py()), None
                except Exception as e:  # what an extractor raises for a malformed file is its own
                    texts, error = [""], f"unreadable pdf: {e}"
                held += [(path.as_py(), sha256.as_py(), i, text, error) for i, text in enumerate(texts, 1)]
                size += sum(map(len, texts))
                if size >= CHARACTERS_AT_ONCE or len(held) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)

    return files.select("path", "sha256", "content").mapInArrow(run, "path string, sha256 string, page int, text string, error string")


def pdf_pages(content: bytes) -> list[str]:
    """The default extractor; its library is asked for only when a PDF is read."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf, or an extractor of your own") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def text_sections(files: DataFrame) -> DataFrame:
    """path, sha256, page (always 1), place, section, text of text files; bytes that are no UTF-8 are replaced."""
    texts = files.filter(F.col("suffix").isin(*TEXT)).select("path", "sha256", "suffix", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return sections(texts, headings="suffix = 'md'", keep=["sha256"]).select("path", "sha256", F.lit(1).alias("page"), "place", "section", "text")


def parsed(files: DataFrame, known: Knowledge, extract: Callable[[bytes], list[str]] = pdf_pages, chunk: Callable[[DataFrame], DataFrame] = cut_chunks) -> tuple[Knowledge, DataFrame]:
    """What new and changed files give, and the report of ingest(). What a run reads is written before it is counted and joined, so every file is parsed once."""
    rows = changed(files, known.files)
    work = rows.filter(F.col("reason").isNull() & (F.col("status") != "unchanged"))
    paged = written(pages(work.filter(F.col("suffix").isin(*PAGES)), extract), "pages")
    parts = text_sections(work).unionByName(paged.filter("error is null").select("path", "sha256", "page", F.col("page").cast("long").alias("place"), F.lit("").alias("section"), "text"))
    new_chunks = written(chunk(parts).select("path", "page", "place", "section", "ord", "text", "sha256"), "chunks")
    cells = written(cells_of(work.filter(F.col("suffix").isin(*TABLES))), "cells")
    good, bad, unusable = specs_of_cells(cells.filter("error is null"))
    new_specs = written(good, "specs")

    # pages without text have no chunk but count; a text file's page has one
    n_pages = paged.filter("error is null").select("path", "page").unionByName(new_chunks.select("path", "page")).groupBy("path").agg(F.count_distinct("page").alias("pages"))
    n_chunks = new_chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    n_specs, n_bad = new_specs.groupBy("path").agg(F.count("*").alias("spec_rows")), bad.groupBy("path").agg(F.count("*").alias("skipped_rows"))
    errors = paged.filter("error is not null").select("path", "error").unionByName(cells.filter("error is not null").select("path", "error")).unionByName(unusable)
    told = rows.select("path", "sha256", "status", "reason")
    for counts in (n_pages, n_chunks, n_specs, n_bad, errors):
        told = told.join(counts, "path", "left")
    none = F.coalesce("chunks", F.lit(0)) + F.coalesce("spec_rows", F.lit(0)) == 0
    reason = F.coalesce("reason", F.when(F.col("status") == "unchanged", "unchanged"), "error", F.when(none, NO_TEXT))
    count = lambda c: F.when(reason.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    report = written(told.select("path", "sha256", reason.alias("reason"), count("pages"), count("chunks"), count("spec_rows"), F.coalesce("skipped_rows", F.lit(0)).cast("long").alias("skipped_rows")), "report")
    done = report.filter("reason is null").select("path", "sha256", "pages", "chunks", "spec_rows")
    return Knowledge(done, new_chunks, new_specs), report.drop("sha256")


def ingest(files: DataFrame, known: Knowledge, extract: Callable[[bytes], list[str]] = pdf_pages, chunk: Callable[[DataFrame], DataFrame] = cut_chunks, prune: bool = False, index: str | None = None) -> tuple[Knowledge, DataFrame]:
    """Knowledge after an ingest of files (with_reasons' columns), and a report: path, reason (null if ingested), pages, chunks, spec_rows, skipped_rows.

    Chunks and specs of new and changed files replace all that was known of the same path; a file that cannot
    be read, or that gives nothing, leaves what was known. Files that are gone keep their rows unless prune is
    set. index: the root of a kept index of the chunks (operators.inverted), which gets a segment of what is new
    and marks for what is gone.
    """
    fresh, report = parsed(files, known, extract, chunk)
    gone = fresh.files.select("path")
    if prune:
        present = files.select("path").distinct()
        gone = gone.unionByName(known.files.select("path").join(present, "path", "left_anti"))
        known = Knowledge(*(x.join(present, "path", "left_semi") for x in known))
    kept = Knowledge(*(x.join(fresh.files.select("path"), "path", "left_anti") for x in known))
    if index is not None:
        row = F.concat_ws("\n", "path", F.col("place").cast("string"), F.col("ord").cast("string"))
        inverted.add(fresh.chunks.withColumn("row", row), index, "path", "row", ["text", "section"], gone=gone, stem=True)
    return Knowledge(*(old.unionByName(new) for old, new in zip(kept, fresh))), report

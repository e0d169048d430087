"""Delimited tables: all text first, headers by alias, then cast; what cannot be used is counted."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import number, spec_key, strip, year_range

#: Accepted headers of spec tables, first choice first.
ALIASES = {
    "make": ("make",), "model": ("model",), "years": ("years", "year", "yr"),
    "year_start": ("year_start", "start_year", "from"), "year_end": ("year_end", "end_year", "to"),
    "ecu_family": ("ecu_family", "ecu", "ecu family", "family"),
    "quantity": ("quantity", "measurement", "parameter", "spec"), "value": ("value", "nominal"),
    "min": ("min", "minimum", "vmin"), "max": ("max", "maximum", "vmax"), "unit": ("unit", "units"),
    "measurement_state": ("measurement_state", "state", "condition"), "page": ("page", "pg"),
}

#: Rows of tables that a task hands over at once.
ROWS_AT_ONCE = 4096
NO_SPECS = "a spec table needs a quantity and a value, min or max"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the header."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def _xlsx_cells(content: bytes) -> list[list[str | None]]:
    """The first sheet's rows; places without a cell are None."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    texts = lambda x: "".join(t.text or "" for t in x.iter(f"{ns}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        sheet = ElementTree.fromstring(book.read(first))
    rows = []
    for line in sheet.iter(f"{ns}row"):
        cells: dict[int, str | None] = {}
        for cell in line.iter(f"{ns}c"):
            at = 0
            for letter in re.match(r"[A-Z]+", cell.get("r", "A1"))[0]:
                at = at * 26 + ord(letter) - 64
            value = cell.find(f"{ns}v")
            text = texts(cell) if cell.get("t") == "inlineStr" else None if value is None else value.text
            cells[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
        rows.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
    return rows


def _csv_cells(content: bytes) -> list[list[str | None]]:
    return [[x or None for x in row] for row in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))]


def cells_of(files: DataFrame) -> DataFrame:
    """path, row, cells (array of text), error of table files (path, suffix, content). A file is one unit of work; one that cannot be read is a row with its error. Rows of many files travel together."""

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for path, suffix, content in zip(*part.columns):
                try:
                    rows, error = (_xlsx_cells if suffix.as_py() == "xlsx" else _csv_cells)(content.as_py()), None
                except (csv.Error, ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError, IndexError) as e:
                    rows, error = [[]], f"unreadable table: {e}"
                for i, cells in enumerate(rows):
                    yield path.as_py(), i, cells, error

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"path": pa.string(), "row": pa.int64(), "cells": pa.list_(pa.string()), "error": pa.string()})
        told = lines(parts)
        while held := list(itertools.islice(told, ROWS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)

    return files.select("path", "suffix", "content").mapInArrow(run, "path string, row long, cells array<string>, error string")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A row per line of the first sheet: file, row, cells (array of text)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lit("xlsx").alias("suffix"), "content")
    return cells_of(files).filter("error is null").select(F.col("path").alias("file"), "row", "cells")


def text_value(x: Column) -> Column:
    """Stripped text; what says nan is empty."""
    text = F.coalesce(strip(x), F.lit(""))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def _normalised(table: DataFrame, raw: Callable[[str], Column], source_file: Column, *keep: str) -> tuple[DataFrame, DataFrame]:
    low, high = year_range(raw("years"))
    given = number(raw("year_start")).isNotNull() | number(raw("year_end")).isNotNull()
    rows = table.select(
        *keep, text_value(raw("make")).alias("make"), text_value(raw("model")).alias("model"),
        F.when(given, number(raw("year_start")).cast("int")).otherwise(low).alias("year_start"), F.when(given, number(raw("year_end")).cast("int")).otherwise(high).alias("year_end"),
        text_value(raw("ecu_family")).alias("ecu_family"), text_value(raw("quantity")).alias("quantity"),
        number(raw("value")).alias("value"), number(raw("min")).alias("vmin"), number(raw("max")).alias("vmax"), text_value(raw("unit")).alias("unit"),
        F.replace(F.upper(text_value(raw("measurement_state"))), F.lit(" "), F.lit("_")).alias("measurement_state"), number(raw("page")).cast("int").alias("page"), source_file.alias("source_file"),
    ).withColumn("spec_key", spec_key("ecu_family", "quantity", "measurement_state"))
    usable = (F.col("quantity") != "") & (F.col("value").isNotNull() | F.col("vmin").isNotNull() | F.col("vmax").isNotNull())
    return rows.filter(usable), rows.filter(~usable)


def spec_rows(table: DataFrame, source_file: Column) -> tuple[DataFrame, DataFrame]:
    """Normalised rows of specs and the rows left out, which lack a quantity or any of value, min and max."""
    names = {c.strip().lower(): c for c in table.columns}
    found = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in ALIASES.items()}
    if found["quantity"] is None or not any(found[k] for k in ("value", "min", "max")):
        raise ValueError(NO_SPECS)
    return _normalised(table, lambda k: F.col(f"`{found[k]}`") if found[k] else F.lit(None).cast("string"), source_file)


def specs_of_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of many tables, each with a header of its own (path, row, cells): normalised rows, rows left out, and the files without the columns that specs need (path, error)."""
    names = F.transform("cells", lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    place = lambda k: F.array_position("names", F.try_element_at(F.filter(F.array(*map(F.lit, ALIASES[k])), lambda a: F.array_contains(F.col("names"), a)), F.lit(1)))
    heads = cells.filter("row = 0").select("path", names.alias("names")).select("path", *(place(k).cast("int").alias(f"_{k}") for k in ALIASES))
    usable = F.col("_quantity").isNotNull() & F.coalesce("_value", "_min", "_max").isNotNull()
    body = cells.filter("row > 0").join(heads.filter(usable), "path")
    good, bad = _normalised(body, lambda k: F.get("cells", F.col(f"_{k}") - 1), F.element_at(F.split("path", "/"), -1), "path", "row")
    empty = heads.filter(~usable).select("path", F.lit(NO_SPECS).alias("error"))
    return good, bad, empty

"""Specs of gates: what is asked alike is resolved once, and citations are put together only where they are asked for."""

import pytest

from quarry.operators import specs
from quarry.plans import registry
from quarry.sources import tables

FOLDER = "/root/testdata/sf0.001"
ROWS = "spec_id long, spec_key string, make string, model string, year_start int, year_end int, value double, vmin double, vmax double, unit string, source_file string, page int"


@pytest.mark.parametrize("name", ["spec_choices", "spec_resolution", "unverified_report"])
def test_citations_are_not_built_unasked(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert " p." not in plan


def test_alike_rows_and_gates_meet_once(spark):
    """500 rows of two kinds and 300 gates of two questions: the rows that meet are those of classes, the citations those of all rows."""
    rows = spark.createDataFrame([(i, "a", "Ford" if i % 2 else "", "", None, None, 1.0 + i % 2 * 1e-9, None, None, "V", "f.pdf", i) for i in range(500)], ROWS)
    gates = spark.createDataFrame([(i, "a", "v", "FORD" if i % 3 else "kia", "", None) for i in range(300)], "gate_key long, spec_ref string, unit string, asked_make string, asked_model string, asked_year int")
    assert specs.classes(rows).count() == 2
    assert specs.candidates(gates.select(*specs.ASKED).distinct(), specs.classes(rows)).count() == 3
    found = {r["gate_key"]: r for r in specs.resolve(gates, rows).collect()}
    cites = {n: "; ".join(f"f.pdf p.{i}" for i in range(0, 500, n)) for n in (1, 2)}
    assert len(found) == 300 and all((r["status"], r["value"], r["cite"]) == ("RESOLVED", 1.0, cites[1 if k % 3 else 2]) for k, r in found.items())


def test_table_files_are_dealt_out_and_travel_together(spark):
    """Files go to tasks by their path before Python reads them, and rows of many files to the next step in batches that may end within a file."""
    plan = registry.QUERIES["spec_tables"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [path" in plan[plan.index("MapInArrow") :]
    n = tables.ROWS_AT_ONCE
    files = [("a.csv", "csv", b"x,y\n" * (n + 1)), ("b.xlsx", "xlsx", b"no book"), ("c.csv", "csv", "﻿q,\n".encode()), ("d.csv", "csv", b"")]
    rows = tables.cells_of(spark.createDataFrame(files, "path string, suffix string, content binary").coalesce(1)).collect()
    assert sorted(r["row"] for r in rows if r["path"] == "a.csv") == list(range(n + 1)) and all(r["cells"] == ["x", "y"] for r in rows if r["path"] == "a.csv")
    assert [(r["path"], r["row"], r["cells"], (r["error"] or "")[:18]) for r in rows if r["path"] != "a.csv"] == [("b.xlsx", 0, [], "unreadable table: "), ("c.csv", 0, ["q", None], "")]

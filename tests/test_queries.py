"""Every registered query of the library's own operators against the same result in SQL."""

import math

import duckdb
import pytest

from quarry.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    other = sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert own == other


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_pool_plan_has_no_python_and_no_nested_loop(spark):
    df = registry.QUERIES["donor_pool"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["donor_pool", "cross_targets", "pending_targets", "cost_plan", "validation_summary"])
def test_members_are_dealt_by_their_number(spark, duck, monkeypatch, name):
    """The tasks of members and targets grow with the line items, not with the session's partitions, and tell the same rows."""
    from quarry.operators import shared
    from quarry.plans import entities

    monkeypatch.setattr(shared, "ROWS_A_TASK", 300)
    tasks = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 300)
    assert tasks > 8 and entities.membership(spark, FOLDER).rdd.getNumPartitions() == tasks
    test_equals_sql(spark, duck, name)

"""BM25 whose scores are summed up where rows are read."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import retrieval

WORDS = ["fuse", "relay", "wire", "ground", "straße", "sensor", "voltage", "the", "crank", "battery"]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(60)]
    rows = [(f"r{i}", t) for i, t in enumerate([*texts, *texts[:20], *["Fuse wire."] * 50, None, "", "- -"])] + [(None, "wire relay")]
    rng.shuffle(rows)
    asked = [(i, " ".join(rng.choices(WORDS + ["nowhere"], k=rng.randint(1, 5)))) for i in range(25)] + [(99, "fuse fuses wire"), (None, "relay"), (100, "the")]
    return spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(rows, "name string, text string").repartition(5)


def told(found):
    return sorted(((r.query_id is None, r.query_id, r.name, round(r.score, 7), r.place if "place" in found.columns else None) for r in found.collect()), key=str)


@pytest.mark.parametrize("k, stem", [(1, False), (4, True), (7, False), (500, False), (None, True)])
def test_rows_scored_in_tasks_equal_rows_scored_by_joins(made, monkeypatch, k, stem):
    """Also with copies in many places, and a query, name or text that is null or has no terms."""
    with monkeypatch.context() as m:
        m.setattr(retrieval, "FEW_QUERIES", 0)
        want = told(retrieval.bm25(*made, "name", "text", k, stem))
    assert want and told(retrieval.bm25(*made, "name", "text", k, stem)) == want


def test_a_blocks_rows_are_cut_as_all_rows_are(made, monkeypatch):
    """The functions of the tasks on batches of any size, in this process: k best by rounded score, then key."""
    runs = []

    class Frame:
        schema = made[1].select("name").schema

        def mapInArrow(self, run, schema):
            runs.append(run)
            return made[0].selectExpr("query_id", "query AS name", "0D AS rounded")

    rng = random.Random(1)
    begin, query, weight = np.array([0, 3, 5]), np.array([0, 1, 2, 0, 2]), np.array([1.0, 2.0, 0.5, 3.0, 1.0])
    batches = [[(f"r{b}-{i}", rng.randint(1, 4), sorted(rng.sample([0, 1], rng.randint(0, 2)))) for i in range(n)] for b, n in enumerate((40, 0, 1, 90))]
    tables = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.list_(pa.int32())), pa.array([[1] * len(x[2]) for x in own], pa.list_(pa.int32()))], names=["name", "length", "ids", "tf"]) for own in batches]
    every = []
    for name, length, ids in (x for own in batches for x in own):
        for q in range(3):
            score = sum(weight[e] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / 2.5)) for t in ids for e in range(begin[t], begin[t + 1]) if query[e] == q)
            every += [(q, round(-score, 9), name)] if score else []
    want = [x for q in range(3) for x in sorted(y for y in every if y[0] == q)[:5]]
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", size)
        retrieval._best_of_tasks(Frame(), made[0].schema["query_id"], pa.array([0, 1, 2]), begin, query, weight, 2.5, "name", 5)
        found = pa.Table.from_batches(list(runs[-1](iter(tables)))).to_pylist()
        assert [(r["query_id"], round(r["rounded"], 9), r["name"]) for r in found] == want


def test_no_score_of_a_row_is_moved(made):
    """Only each task's best of a query go on: one exchange, and no join, stands behind the rows' counts."""
    plan = retrieval.bm25(*made, "name", "text")._jdf.queryExecution().executedPlan().toString()
    plan = plan.partition("== Initial Plan ==")[2] or plan
    assert plan.count("Exchange") == 1 and "Join" not in plan

"""An ingest moves what it must and no more: texts are cut and terms counted where they are read."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import stemming
from quarry.operators import inverted
from quarry.sources.documents import sections


def test_sections_and_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a.md", "x\r\n# One\ny\r# Two #\n\nz "), ("b.md", "# Only"), ("c.txt", "# no\nhead"), ("d.md", None), ("e.md", "")], "path string, text string")
    found = sections(rows, headings="path like '%.md'")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a.md", 0, "", "x"), ("a.md", 1, "One", "y"), ("a.md", 2, "Two #", "z"), ("c.txt", 0, "", "# no\nhead")]
    seen = []
    monkeypatch.setattr(inverted, "_write", lambda spark, root, number, postings, *more: seen.append(postings))
    inverted.add(rows.filter("text <> ''"), str(tmp_path / "index"), "path", "path", "text", stem=True)
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.row, r.length, r.tf) for r in seen[0].collect() if r.row == "c.txt"} == {("no", "c.txt", 2, 1), ("head", "c.txt", 2, 1)}


def test_terms_are_counted_in_bounded_groups(spark, monkeypatch):
    chosen = random.Random(7)
    rows = [[chosen.choice(("cranks", "cranking", "crank", "réunion", "a", "dry", "12")) for _ in range(n)] for n in (0, 1, 700, 3, 0, 2000, 40)]
    monkeypatch.setattr(stemming, "WORDS_AT_ONCE", 500)
    for stem in (False, True):
        made = []
        monkeypatch.setattr(stemming.F, "arrow_udf", lambda f, kind: made.append(f) or (lambda x: None))
        stemming.term_counts("terms", stem)
        got = made[0](pa.array([[], *rows, None], pa.list_(pa.string())).slice(1)).to_pylist()
        monkeypatch.undo()
        monkeypatch.setattr(stemming, "WORDS_AT_ONCE", 500)
        want = [Counter(map(stemming._one, r) if stem else r) for r in rows]
        assert [{x["term"]: x["tf"] for x in r} for r in got] == [*map(dict, want), {}]
        assert made[0](pa.array([], pa.list_(pa.string()))).to_pylist() == []
    assert spark.createDataFrame([(["dry", "dries", "dry"],)], "t array<string>").select(F.sort_array(stemming.term_counts("t", True))).first()[0] == [("dri", 1), ("dry", 2)]

"""The secrets network learns from every window of the texts, however they are dealt out."""

import numpy as np
from quarry.llm import secrets

WORDS = "river garden window market bridge silver yellow morning".split()


def docs_of(spark, n):
    two = lambda i: WORDS[i % 8] + WORDS[i // 8 % 8] + WORDS[i * 3 % 8]
    rows = [(i, f"text {two(i)} and {two(i + 9)} then token=aB{i}xY7z{i * 7919 % 1000}Qk") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_negative_of_a_text_is_a_window(spark):
    docs = spark.createDataFrame([(0, "the rivergardenwindow and marketbridgesilver then token=aB0xY7z0Qk")], "doc_id long, text string")
    assert sorted(r["label"] for r in secrets.training_windows(docs).collect()) == [0, 0, 1]


def test_each_row_is_dealt_before_any_comes_again():
    network, seen = secrets.CharNetwork(), []
    forward = network._forward
    network._forward = lambda x: seen.extend(r.tobytes() for r in x) or forward(x)
    x, y = secrets.starting_set()
    network.fit(x, y, 9, 2, 0.005, whole=True)
    assert set(seen) == {r.tobytes() for r in x}


def test_the_model_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SHARE", 100)
    docs = docs_of(spark, 150)
    one, other = secrets.fit_network(docs.coalesce(1)), secrets.fit_network(docs.repartition(7))
    assert (one.weights == other.weights).all() and (one.thresholds == other.thresholds).all() and (one.weights != secrets._started()[0].weights).any()
    assert np.isfinite(one.weights).all()

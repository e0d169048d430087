"""What a Python worker holds does not grow with the batch that it is given."""

import pyarrow as pa

from quarry.operators import retrieval
from quarry.sources import documents, sinks


def run_of(monkeypatch, frame, make):
    caught = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    make(frame)
    monkeypatch.undo()
    return caught[0]


def test_chunks_and_pages_travel_in_bounded_batches(spark, monkeypatch):
    texts = [None, "", *("some words " * (i * 37 % 900) for i in range(1500)), "end"]
    frame = spark.createDataFrame([(0, "a", "x")], "k long, t string, z string")
    run = run_of(monkeypatch, frame, lambda f: retrieval.chunks(f, "t"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["z"] * len(texts)), pa.array(texts)], names=["k", "z", "t"])
    found = list(run(iter([batch.slice(1), batch.slice(0, 1), batch.slice(0, 0)])))
    assert len(found) > 4 and max(b.num_rows for b in found) < 2 * retrieval.CHARACTERS_AT_ONCE // 600
    want = [(k, "z", i, piece) for k, pieces in enumerate(retrieval.windows([x or "" for x in texts])) for i, piece in enumerate(pieces)]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want

    files = spark.createDataFrame([("p", "h", b"")], "path string, sha256 string, content binary")
    run = run_of(monkeypatch, files, lambda f: documents.pages(f, lambda x: [x.decode(), ""]))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.pdf" for i in range(len(texts))]), pa.array(["h"] * len(texts)), pa.array([(x or "").encode() for x in texts[:-1]] + [b"\xff"])], names=["path", "sha256", "content"])
    found = list(run(iter([batch])))
    assert len(found) > 4 and sum(b.num_rows for b in found) == 2 * len(texts) - 1
    assert found[-1].to_pylist()[-1]["error"].startswith("unreadable pdf")


def test_files_are_written_without_copies_of_a_batch(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([("p", "x")], "path string, content string")
    run = run_of(monkeypatch, frame, lambda f: sinks.write_text_files(f, str(tmp_path)))
    texts = ["é" * 5_000_000, "", "end\r\n"]
    base, tracked = pa.total_allocated_bytes(), []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(["a/b.txt", "c.txt", "a/d.txt"]), pa.array(texts)], names=["path", "content"])

    def batches():
        for _ in range(3):
            yield make()
            tracked.append(pa.total_allocated_bytes() - base)

    assert [b.to_pydict() for b in run(batches())] == [{"path": ["a/b.txt", "c.txt", "a/d.txt"], "bytes": [10_000_000, 0, 5]}] * 3
    assert max(tracked) < 5_000_000  # nothing of a batch is held when the next is asked for
    assert [(tmp_path / p).read_bytes().decode() for p in ("a/b.txt", "c.txt", "a/d.txt")] == texts

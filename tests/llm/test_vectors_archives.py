import io
import zipfile

import numpy as np
import pytest

from quarry.llm import projection_forest, topk_search, warc_zip
from quarry.llm.common import shared_dir


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string, rank string") if rows and len(rows[0]) == 5 else spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<float>, label int, n_links string, rank string")


def sample(seed=1, n=600, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.05, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0], 1), (1003, [float("nan"), 1.0], 1), (1004, [float("inf"), 1.0], 1), (1005, [1.0, None], 1), (1006, [1.0, 2.0], None), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (1009, [1.0, 2.0, 0.0], 1)]


def brute_links(rows, threshold=0.98):
    good = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _, _ in rows}
    for a, (i, v, l) in enumerate(good):
        for j, w, m in good[a + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                near[i].add(j)
                near[j].add(i)
    seen = {}
    for i in sorted(near):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += near[x]
    return {i: (len(near[i]), seen[i], seen[i] == i) for i in near}


@pytest.mark.parametrize("leaf, block", [(256, 128), (32, 128), (16, 8)])
def test_near_duplicates(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(projection_forest, "LEAF", leaf)
    monkeypatch.setattr(projection_forest, "BLOCK", block)
    rows = sample() + ODD
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projection_forest.near_duplicates(vectors(spark, rows)).collect()}
    want = brute_links(rows)
    links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in got)
    assert found >= 0.95 * links and (leaf < 256 or got == want)


def test_forest_at_every_size():
    """Leaves stay within a few times LEAF vectors from 60 to 100,000 in one label, beyond what a sample of production size can split by itself, and planted pairs meet."""
    rng = np.random.default_rng(5)
    for n in (60, 3_000, 100_000):
        points = rng.normal(size=(n, 32))
        copies = points[: n // 3] + rng.normal(size=(n // 3, 32)) * 0.02
        x = projection_forest.unit(np.concatenate([points, copies]))
        depth = int(np.ceil(np.log2(len(x) / projection_forest.LEAF)))
        forest = projection_forest.Forest(x[rng.permutation(len(x))[: projection_forest.SAMPLE]], depth)
        row, code = forest.leaves(x, np.full(len(x), depth))
        assert depth > 0 and len(row) >= len(x) * forest.trees
        sizes = np.unique(code, return_counts=True)[1]
        assert np.average(sizes, weights=sizes) <= 3.5 * projection_forest.LEAF and sizes.max() <= 16 * projection_forest.LEAF
        own = [set() for _ in range(len(x))]
        for r, c in zip(row.tolist(), code.tolist()):
            own[r].add(c)
        assert np.mean([bool(own[i] & own[n + i]) for i in range(n // 3)]) >= 0.99


def test_dense_groups_of_near_copies(spark):
    """Groups of hundreds of near copies, which any split at a median would cut: all links of every vector."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 24))
    x = np.concatenate([c + rng.normal(size=(n, 24)) * 0.09 for c, n in zip(centres, (900, 500, 200))] + [rng.normal(size=(900, 24))]).astype(np.float32)
    u = projection_forest.unit(x.astype(float))
    near = u @ u.T >= 0.98
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in projection_forest.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 300_000 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_recall_with_many_vectors_in_one_label(spark):
    rng = np.random.default_rng(6)
    n, dim = 20_000, 24
    base = rng.normal(size=(n // 2, dim)).astype(np.float32)
    near = base[rng.integers(0, n // 2, n - n // 2)] + rng.normal(size=(n - n // 2, dim)).astype(np.float32) * rng.choice([0.05, 0.12, 0.2], (n - n // 2, 1)).astype(np.float32)
    x = np.concatenate([base, near])
    u = projection_forest.unit(x.astype(float))
    want = sum(int((u[i : i + 2000] @ u.T >= 0.98).sum()) for i in range(0, n, 2000)) - n
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = projection_forest.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * want <= got <= want and want > 5_000


def test_near_duplicates_of_nothing(spark):
    assert projection_forest.near_duplicates(vectors(spark, sample()).limit(0)).count() == 0
    rows = [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)]
    got = sorted(map(tuple, projection_forest.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (3, 1, 3, True), (3, 1, 3, True)], key=str)


def test_top_k(spark):
    rows = sample(7, 330) + [(400, [0.5] * 16, 0), (401, [0.5] * 16, 0), (402, [0.5] * 16, 0), *ODD[:6]]
    got = {}
    for r in topk_search.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in usable)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    for q, v in usable:
        if q % 50 == 0:
            want = sorted(((-int(v @ w), i) for i, w in usable if i != q))[:5]
            assert got.pop(q) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert not got


def test_top_k_small_and_large(spark, monkeypatch):
    assert topk_search.top_k(vectors(spark, sample()).limit(0)).count() == 0
    few = topk_search.top_k(vectors(spark, [(0, [1.0], 0), (1, [2.0, 5.0], 0), (2, [-1.0], None)])).orderBy("rank").collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    big = topk_search.top_k(vectors(spark, [(0, [1e30], 0), (1, [2e30], 0), (2, [1e30], 0)])).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in big] == [(1, None), (2, None)]
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    rows = sample(3, 300)
    assert topk_search.top_k(vectors(spark, rows)).count() == 30


def test_ties_across_blocks_and_tasks(spark, monkeypatch):
    """Equal scores in several candidate blocks, tasks and query blocks, also with sparse rows: the smaller ids win."""
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(topk_search, "HELD", 20)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.integers(0, 2, 6) * 0.25 if i % 4 else np.zeros(6))], 0) for i in range(400)]
    got = {}
    for r in topk_search.top_k(vectors(spark, rows).repartition(5)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    grid = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows]
    for q, v in grid[::50]:
        want = sorted((-int(v @ w), i) for i, w in grid if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70000), (None, "u", "<p>same</p>"), (7, "u", "alone"), (7, "u", "alone")]


def test_packages(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    folder = shared_dir(spark, "test-wacz")
    got = warc_zip.read_packages(spark, folder, warc_zip.write_packages(df, folder), payload=True).collect()
    assert len(got) == len(PAGES)
    by = {(r.page_id): r for r in got}
    assert (by[2].record_type, by[1].record_type, by[1].refers_to, by[None].refers_to, by[None].record_type) == ("response", "revisit", 2, 2, "revisit")
    assert (by[4].record_type, by[3].record_type, by[3].refers_to, by[3].payload_bytes) == ("response", "revisit", 4, 0)
    assert by[5].payload_bytes == 140000 and bytes(by[5].payload).decode() == "é" * 70000 and by[5].payload_digest == warc_zip.digest(("é" * 70000).encode())
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "response"]
    assert {r.record_type for r in warc_zip.package_round_trip(df, min_bytes=100_000).collect()} == {"response"}
    assert warc_zip.package_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_central_directory(monkeypatch, large):
    """Plain and ZIP64 directories, a comment behind the end record, and a member that is not stored."""
    if large:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"c" * 300
        z.writestr("a.txt", b"hello" * 9)
        with z.open("b/ä.bin", "w", force_zip64=True) as m:
            m.write(b"x" * 99)
        z.writestr(zipfile.ZipInfo("c"), b"packed" * 50, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    read = lambda at, n: data[at : at + n]
    found = warc_zip.central_directory(read, len(data))
    assert set(found) == {"a.txt", "b/ä.bin", "c"} and (b"PK\x06\x06" in data) == large
    assert read(*warc_zip.stored_member(read, found["a.txt"])) == b"hello" * 9 and read(*warc_zip.stored_member(read, found["b/ä.bin"])) == b"x" * 99
    with pytest.raises(ValueError):
        warc_zip.stored_member(read, found["c"])
    with pytest.raises(ValueError):
        warc_zip.central_directory(lambda at, n: b"\0" * n, 100)

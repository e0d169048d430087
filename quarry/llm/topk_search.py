"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

A vector's components are its terms. A block of candidates keeps, for each term, the postings: the rows
that have it and their weights. The non-zero terms of the sparse query rows scatter their products into a
dense array of scores, partition selection keeps the best of each block, and a ranked merge keeps the best
of all.

Queries are written to the shared folder in blocks of about QUERY_BLOCK rows (by a hash of their id). One
job reads the candidates: a task gathers up to HELD of them, then reads one query block after the other, so
what it holds is bounded and no query passes the driver.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; missing
terms of shorter vectors count as zero; a repeated query id asks once, with its smallest vector; repeated
candidates rank each by itself; ties go to the smaller vec_id; scores beyond 64 bits are kept in order and
returned as null; an empty table gives no rows; very long vectors have as many terms; other columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_dir

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 4096
QUERIES_AT_ONCE = 64
#: Candidates that a task holds while the query blocks pass.
HELD = 1 << 17
SCALE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)


def weights(vectors: list[list[float]]) -> np.ndarray:
    """floor(SCALE * x) as integers, padded with zeros; Python integers where 64 bits could overflow."""
    width = max(map(len, vectors), default=0)
    grid = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        grid[i, : len(v)] = v
    grid = np.floor(SCALE * grid)
    if not len(grid) or np.abs(grid).max() < 2**62:
        return grid.astype(np.int64)
    return np.array([[int(x) if np.isfinite(x) else 0 for x in row] for row in grid.tolist()], object)


class Postings:
    """Of a block of candidates, for each term the rows that have it and their weights; None for rows where all have it."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray):
        self.ids, self.size = ids, len(grid)
        self.most = int(np.abs(grid).max(initial=0))
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        for column in grid.T:
            rows = np.flatnonzero(column)
            self.terms.append((None, np.ascontiguousarray(column)) if len(rows) == len(grid) else (rows, column[rows]))


def accumulate(queries: np.ndarray, postings: Postings) -> np.ndarray:
    """Scores [query, candidate], one term after the other."""
    terms = min(queries.shape[1], len(postings.terms))
    reach = int(np.abs(queries).max(initial=0)) * postings.most * max(1, terms)
    kind = np.int32 if reach < 2**31 else np.int64 if reach < 2**63 else object
    queries = queries.astype(kind)
    scores = np.zeros((len(queries), postings.size), kind)
    for t, (rows, weight) in enumerate(postings.terms[:terms]):
        asks = np.flatnonzero(queries[:, t])
        product = queries[asks, t, None] * weight.astype(kind)[None, :]
        if rows is None and len(asks) == len(queries):
            scores += product
        elif rows is None:
            scores[asks] += product
        elif len(asks) and len(rows):
            scores[np.ix_(asks, rows)] += product
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best (scores, ids), ties to smaller ids; its own id is left out."""
    found = []
    for row, me in zip(scores, own.tolist()):
        keep = np.flatnonzero(ids != me)
        if len(keep) > k:
            part = row[keep]
            least = np.partition(part, len(part) - k)[len(part) - k]
            keep = keep[part >= least]
        order = keep[np.lexsort((ids[keep], -row[keep]))][:k] if row.dtype != object else np.array(sorted(keep, key=lambda i: (-row[i], ids[i]))[:k], np.int64)
        found.append((row[order], ids[order]))
    return found


def _query_blocks(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and weights of each block of queries in the shared folder."""
    fs, path = filesystem(folder)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
    for name in names:
        with fs.open_input_file(name) as f:
            found = pq.read_table(f, columns=["vec_id", "vector"])
        if found.num_rows:
            yield np.asarray(found.column("vec_id")), weights(found.column("vector").to_pylist())


def _merged(kept: list, found: list[tuple[np.ndarray, np.ndarray]], first: int, k: int) -> None:
    """The k best of what is kept and found, for the queries from first on."""
    for j, (s, n) in enumerate(found, first):
        s, n = np.concatenate([kept[j][0], s.astype(object if s.dtype == object else np.int64)]), np.concatenate([kept[j][1], n])
        order = sorted(range(len(s)), key=lambda x: (-s[x], n[x]))[:k]
        kept[j] = (s[order], n[order])


def search(candidates: DataFrame, folder: str, k: int) -> DataFrame:
    """query_id, vec_id, score, coarse: the k best for every query in folder, of each HELD candidates that a task reads."""

    def answered(held: list[Postings]) -> Iterator[pa.RecordBatch]:
        for own, queries in _query_blocks(folder):
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
            for postings in held:
                for i in range(0, len(own), QUERIES_AT_ONCE):
                    scores = accumulate(queries[i : i + QUERIES_AT_ONCE], postings)
                    _merged(kept, best(scores, postings.ids, own[i : i + QUERIES_AT_ONCE], k), i, k)
            sizes = [len(n) for _, n in kept]
            if sum(sizes):
                score = [int(x) for s, _ in kept for x in s.tolist()]
                fits = [x if -(2**63) <= x < 2**63 else None for x in score]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([n for _, n in kept])), pa.array(fits, pa.int64()), pa.array([float(x) for x in score])], ["query_id", "vec_id", "score", "coarse"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Postings] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                held.append(Postings(np.asarray(part.column(0)), weights(part.column(1).to_pylist())))
                size += part.num_rows
            if size >= HELD:
                yield from answered(held)
                held, size = [], 0
        if held:
            yield from answered(held)

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long, coarse double")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k best others."""
    rows = usable(vectors)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    folder = shared_dir(vectors.sparkSession, "queries")
    queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "block").write.mode("overwrite").parquet(folder, partitionBy="block")
    order = Window.partitionBy("query_id").orderBy(F.desc("coarse"), F.desc_nulls_first("score"), "vec_id")
    return search(rows, folder, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Ranked lexical search: a blocked sparse product of item-term multiplicities and term-document impacts.

Terms are the runs of ASCII letters and digits and of all other than ASCII characters; of letters only A to Z are
lower-cased. One reading of the documents keeps, of each, its number of terms and how often each term that any
item asks for stands in it. Their sums give N, L and the document frequencies. Then a task gathers up to
HELD entries of documents as a block of the term-document matrix, sorted by term, each entry an integer impact,
and reads the items' rows block by block from the shared folder. An item's row merges the postings of its terms,
times their multiplicities, into one dense row of scores (Gustavson's order), of which the k best are kept; the
task merges its blocks' rows, and a ranked window merges the tasks'.

What a task holds is bounded by constants: VOCABULARY terms, HELD entries, ITEM_ENTRIES entries of items (and one
document's, or item's, own terms). No items, terms or documents pass the driver.

Defined cases: a null or empty text has no term and is in no result; a document without doc_id counts in N, L and the
document frequencies and is in no result; repeated rows rank each by itself, with the same doc_id; ties go to the
smaller doc_id; an item_id that stands in several rows asks once, with its smallest text; an item without item_id, or
without a term of any document, has no rows; empty tables give none; very long texts are split and read whole;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.merge import numbered

from .common import filesystem, shared_dir, text_of, worker_state, written

TOP = 20
#: Terms of the items that a task looks up at once.
VOCABULARY = 1 << 20
#: Entries (document, term) that a task holds as one block, and documents in it.
HELD, DOCUMENTS = 1 << 22, 1 << 16
#: Entries (item, term) of a block of items, about.
ITEM_ENTRIES = 1 << 20
PIECE = 1 << 20
#: Bytes of UTF-8: a term's own byte, lower-cased, or a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text of UTF-8 bytes; no more than about PIECE bytes are split at a time."""
    plain = text.translate(_BYTES)
    counts: Counter = Counter()
    at = 0
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            cut = plain.rfind(b" ", at, end)
            cut = cut if cut >= 0 else plain.find(b" ", end)
            end = cut + 1 if cut >= 0 else len(plain)
        counts.update(plain[at:end].split())
        at = end
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: a row per item and term of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_py())
                terms = list(counts)
                for i in range(0, len(terms), 1 << 16):
                    own = terms[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array([counts[t] for t in own], pa.int64())], ["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).filter(F.col("item_id").isNotNull())
    rows = rows.groupBy("item_id").agg(F.min("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary, times long")


def _files(folder: str) -> list[str]:
    fs, path = filesystem(folder)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))


def _read(folder: str, path: str, columns: list[str]) -> pa.Table:
    with filesystem(folder)[0].open_input_file(path) as f:
        return pq.read_table(f, columns=columns)


def document_entries(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n (terms in it), terms and times of those that the items ask for; a row per document.

    vocabulary: folder of files of at most about VOCABULARY terms with their ids. One file is kept by the
    worker; of more, each is read once for the documents that a task gathers.
    """

    def found(held: list[tuple[int | None, Counter]]) -> pa.RecordBatch:
        terms: list[list[int]] = [[] for _ in held]
        times: list[list[int]] = [[] for _ in held]
        for path in _files(vocabulary):

            def load(path: str = path) -> dict[bytes, int]:
                table = _read(vocabulary, path, ["term", "id"])
                return dict(zip(table.column("term").to_pylist(), table.column("id").to_pylist()))

            ids = worker_state((vocabulary, path), load)
            for own_terms, own_times, (_, counts) in zip(terms, times, held):
                for term in counts.keys() & ids.keys():
                    own_terms.append(ids[term])
                    own_times.append(counts[term])
        n = [sum(counts.values()) for _, counts in held]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, Counter]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, term_counts(text.as_py())))
                size += len(held[-1][1])
                if size >= HELD // 16 or len(held) >= DOCUMENTS // 16:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, times array<long>")


class Block:
    """Some documents' columns of the term-document matrix, entries sorted by term."""

    def __init__(self, doc_ids: list[np.ndarray], lengths: list[np.ndarray], sizes: list[np.ndarray], terms: list[np.ndarray], times: list[np.ndarray], n_docs: int, n_terms: int):
        self.doc_ids = np.concatenate(doc_ids)
        # Python integers: 25 * n * N may pass 64 bits before the division
        m = np.array([75 + 25 * n * n_docs // n_terms for n in np.concatenate(lengths).tolist()], np.int64)
        docs = np.repeat(np.arange(len(self.doc_ids), dtype=np.int32), np.concatenate(sizes))
        terms, times = np.concatenate(terms), np.concatenate(times)
        order = np.argsort(terms, kind="stable")
        self.docs, times = docs[order], times[order]
        self.ratio = (1_000_000_000 * times) // (1000 * times + 12 * m[self.docs])
        self.terms, begins = np.unique(terms[order], return_index=True)
        self.begins = np.append(begins, len(order))

    def product(self, terms: np.ndarray, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
        """An item's row of scores: its terms' impacts (weight times ratio), times their multiplicity, merged by document."""
        row = np.zeros(len(self.doc_ids), np.int64)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            for a, w, x in zip(at.tolist(), weights.tolist(), np.where(self.terms[at] == terms, times, 0).tolist()):
                if w and x:  # a document stands once in a term's postings
                    own = slice(self.begins[a], self.begins[a + 1])
                    row[self.docs[own]] += x * (w * self.ratio[own])
        return row


def best(scores: np.ndarray, doc_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, doc_ids) above 0, ties to smaller ids."""
    keep = np.flatnonzero(scores > 0)
    if len(keep) > k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least]
    order = keep[np.lexsort((doc_ids[keep], -scores[keep]))][:k]
    return scores[order], doc_ids[order]


def search(entries: DataFrame, folder: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best for each item in folder, of each block that a task gathers."""

    def answered(block: Block) -> Iterator[pa.RecordBatch]:
        for path in _files(folder):
            table = _read(folder, path, ["item_id", "terms", "weights", "times"])
            items, ids, scores = [], [], []
            for rows in table.to_batches(256):
                for item, own in zip(rows.column(0).to_pylist(), zip(*(rows.column(c) for c in (1, 2, 3)))):
                    s, d = best(block.product(*(np.asarray(x.values) for x in own)), block.doc_ids, k)
                    items += [item] * len(s)
                    ids.append(d)
                    scores.append(s)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        entries_held = docs_held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                terms, times = part.column(2), part.column(3)
                sizes = np.diff(np.asarray(terms.offsets))
                held.append((np.asarray(part.column(0)), np.asarray(part.column(1)), sizes, np.asarray(terms.flatten()), np.asarray(times.flatten())))
                entries_held += len(held[-1][3])
                docs_held += part.num_rows
                if entries_held >= HELD or docs_held >= DOCUMENTS:
                    yield from answered(Block(*map(list, zip(*held)), n_docs, n_terms))
                    held, entries_held, docs_held = [], 0, 0
        if held:
            yield from answered(Block(*map(list, zip(*held)), n_docs, n_terms))

    rows = entries.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    asked = written(item_terms(items), "asked")
    named = numbered(asked.select("term").distinct(), ["term"], 0)
    n_named = asked.select("term").distinct().count()
    vocabulary, blocks = shared_dir(spark, "vocabulary"), max(1, -(-n_named // VOCABULARY))
    named.withColumn("file", F.floor(F.col("id") / VOCABULARY)).repartition(blocks, "file").select("term", "id").write.mode("overwrite").parquet(vocabulary)
    entries = written(document_entries(docs, vocabulary), "entries")
    n_docs, n_terms = entries.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = entries.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int64())], ["term", "weight"])

    ids = spark.read.parquet(vocabulary)
    weights = ids.join(frequency, "id").select("term", "id", "df")
    weights = weights.select("id", "df").mapInArrow(weighed, "term long, weight long").withColumnRenamed("term", "id").join(ids, "id")
    rows = asked.join(weights, "term").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("id", "weight", "times"))).alias("own"))  # an item's own terms
    rows = written(rows.select("item_id", F.col("own.id").alias("terms"), F.col("own.weight").alias("weights"), F.col("own.times").alias("times")), "items")
    size = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    folder, parts = shared_dir(spark, "items"), max(1, -(-size // ITEM_ENTRIES))
    rows.repartition(parts, "item_id").write.mode("overwrite").parquet(folder)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = search(entries, folder, n_docs, max(1, n_terms), k)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Chunks of documents, an inverted index over them, and BM25 retrieval for many queries at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quarry.functions.stemming import fold_and_stem
from quarry.functions.text import col

from .shared import written

SIZE, OVERLAP, REACH = 800, 100, 120
#: About so many characters are cut side by side, however many texts a batch has.
CHARACTERS_AT_ONCE = 1 << 20
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words that a query does without.
STOP_WORDS = [
    "the", "an", "and", "or", "of", "to", "in", "on", "at", "is", "are", "was", "be", "it", "its", "this", "that", "with", "for",
    "from", "by", "as", "do", "does", "did", "not", "no", "yes", "how", "what", "why", "when", "where", "which", "who", "can",
    "could", "should", "will", "about", "any", "all",
]


def window_bounds(lengths: np.ndarray, spaces: np.ndarray, size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and end of every window over texts of these lengths that stand behind each other; spaces: ascending places of their spaces.

    All texts advance side by side. A full window ends at the last space of its last reach characters, if
    there is one, found by a search among the spaces; the next begins overlap before its end.
    """
    stop = np.cumsum(lengths)
    owner = np.flatnonzero(lengths)
    begin = (stop - lengths)[owner]
    known = np.append(spaces, -1)  # the last one answers where no space stands before
    rounds = []
    while len(owner):
        limit = begin + size
        last = known[np.searchsorted(spaces, limit) - 1]
        full = limit < stop[owner]
        end = np.where(full & (last >= limit - reach), last, np.minimum(limit, stop[owner]))
        rounds.append((owner, begin, end))
        owner, begin = owner[full], np.maximum(end - overlap, begin + 1)[full]
    found = [np.concatenate(x) if rounds else np.zeros(0, np.int64) for x in zip(*rounds)] if rounds else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((found[1], found[0]))
    return found[0][order], found[1][order], found[2][order]


def windows(texts: list[str], size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH) -> list[list[str]]:
    """Each text, its white space as single spaces, in pieces of about size characters."""
    plain = [" ".join(x.split()) for x in texts]
    joined = "".join(plain)
    spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 0x20)
    found: list[list[str]] = [[] for _ in texts]
    for i, a, b in zip(*(x.tolist() for x in window_bounds(np.array([len(x) for x in plain], np.int64), spaces, size, overlap, reach))):
        if piece := joined[a:b].strip():
            found[i].append(piece)
    return found


def _groups(lengths: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Begin and end of groups of texts with about so much in all, CHARACTERS_AT_ONCE where nothing is said."""
    groups = np.cumsum(lengths) // (size or CHARACTERS_AT_ONCE)
    return itertools.pairwise([0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(lengths)])


def chunk_array(text: Column | str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        own = [x or "" for x in texts]
        cut = (windows(own[a:b]) for a, b in _groups(np.array([len(x) for x in own], np.int64)))
        return pd.Series([w for group in cut for w in group], index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def chunks(sections: DataFrame, text: str = "text") -> DataFrame:
    """A row per chunk with its place (ord) in its section; sections' other columns stay. Chunks of about a million characters travel together."""
    others = [c for c in sections.columns if c != text]
    schema = StructType([*(StructField(f.name, f.dataType) for f in sections.select(*others).schema), StructField("ord", IntegerType()), StructField(text, StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in _groups(pc.utf8_length(part.column(len(others))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                own = part.slice(a, b - a)
                cut = windows([x or "" for x in own.column(len(others)).to_pylist()])
                row = pa.array(np.repeat(np.arange(len(cut)), [len(x) for x in cut]))
                places = pa.array([i for x in cut for i in range(len(x))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(own.column(i).take(row) for i in range(len(others))), places, pa.array([w for x in cut for w in x], pa.string())], names=schema.names)

    return sections.select(*others, text).mapInArrow(run, schema)


def terms(text: Column | str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column | str) -> Column:
    """Distinct terms of a query in order: ASCII, two characters at least, no stop words."""
    words = F.transform(F.regexp_extract_all(col(query), F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))


def asked_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """query_id, term and how many of the query's distinct terms have that stem."""
    asked = queries.select("query_id", F.explode(query_terms("query")).alias("term"))
    if stem:
        asked = asked.select("query_id", fold_and_stem("term").alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))


#: As many asked forms of words, asked terms and queries are sent to every task; of more, terms and scores are joined by Spark's own choice.
FEW_FORMS, FEW_QUERIES = 200_000, 1 << 14
#: About so many words are looked up, and scores of a row for a query summed up, side by side.
WORDS_AT_ONCE, SCORES_AT_ONCE = 1 << 18, 1 << 18


def bm25(queries: DataFrame, rows: DataFrame, key: str, text: Column | str | list[str], k: int | None = 4, stem: bool = False) -> DataFrame:
    """query_id, key, score and place of the k best rows for each query (all matches with k None); lower scores are better.

    text may be several columns, such as a text and its section, which count as one. key names a row; one without is in no result. A row's length is
    told from its own terms; only terms that are asked for are kept, counted where the row is read, and a row's scores
    for all queries are summed up in one task, which passes on its k best of each query. With stem, each
    distinct term of the rows is folded and stemmed once, and those of an asked stem are looked for. Query
    terms are distinct before stemming, so two forms of one word count twice.
    """
    text = F.concat_ws(" ", *text) if isinstance(text, list) else text
    own = rows.select(key, terms(F.coalesce(col(text), F.lit(""))).alias("terms"))
    asked = written(asked_terms(queries, stem), "asked")
    wanted = asked.select("term").distinct()
    if stem:
        forms = own.select(F.explode("terms").alias("form")).distinct().withColumn("term", fold_and_stem("form")).join(wanted, "term", "left_semi")
    else:
        forms = wanted.select("term", F.col("term").alias("form"))
    forms = written(forms, "forms")
    if forms.count() <= FEW_FORMS and asked.count() <= FEW_FORMS and asked.select("query_id").distinct().count() <= FEW_QUERIES:
        return _scored_by_row(own, asked, forms.toArrow(), key, k)
    words = own.filter(F.col(key).isNotNull()).select(key, F.size("terms").alias("length"), F.explode("terms").alias("form"))
    hits = written(words.join(forms, "form").groupBy("term", key).agg(F.count("*").alias("tf"), F.max("length").alias("length")), "postings")
    total = own.agg(F.count("*").alias("n_rows"), F.avg(F.size("terms")).alias("mean_length"))
    return scored(hits, asked, total, key, k)


def _scored_by_row(own: DataFrame, asked: DataFrame, forms: pa.Table, key: str, k: int | None) -> DataFrame:
    """bm25 for few queries: rows' counts of asked terms, written as one row each, times the asked terms' weights."""
    counted = written(_asked_counts(own, forms, key), "counts")
    n_rows, mean_length = counted.agg(F.count("*"), F.avg("length")).first()
    counted = counted.filter(F.col(key).isNotNull())
    frequency = counted.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # at most FEW_FORMS
    return _best_of_tasks(counted, asked.schema["query_id"], *_weights(asked.toArrow(), _distinct_terms(forms), frequency, n_rows), mean_length, key, k)


def _distinct_terms(forms: pa.Table) -> pa.Array:
    return pa.array(sorted(set(forms.column("term").to_pylist())), pa.string())


def _asked_counts(own: DataFrame, forms: pa.Table, key: str) -> DataFrame:
    """key, length, ids of the asked terms of each row in order, and how often each stands there (tf)."""
    known = forms.column("form").combine_chunks()
    id_of = pc.index_in(forms.column("term").combine_chunks(), value_set=_distinct_terms(forms)).to_numpy(zero_copy_only=False)
    n_terms = len(known) + 1
    schema = StructType([own.schema[0], StructField("length", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])

    def counts(rows: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        lengths = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(rows.flatten(), value_set=known)
        hit = place.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rows), dtype=np.int64), lengths)[hit]
        found, times = np.unique(owner * n_terms + id_of[place.drop_null().to_numpy()], return_counts=True)
        edges = pa.array(np.searchsorted(found, np.arange(len(rows) + 1) * n_terms), pa.int32())
        return pa.array(lengths), pa.ListArray.from_arrays(edges, pa.array(found % n_terms, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), WORDS_AT_ONCE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *counts(part.column(1))], names=schema.names)

    return own.mapInArrow(run, schema)


def _weights(asked: pa.Table, known: pa.Array, frequency: pa.Table, n_rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct query ids; by id of a term, where its entries begin; the entries' queries and weights. A term of no row has no use."""
    df = np.zeros(len(known), np.float64)
    df[frequency.column("id").to_numpy()] = frequency.column("count").to_numpy()
    idf = np.log((n_rows - df + 0.5) / (df + 0.5))
    idf = np.where(idf <= 0, LEAST_IDF, idf)
    query = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    term = pc.fill_null(pc.index_in(asked.column("term").combine_chunks(), value_set=known), -1).to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    order = order[term[order] >= 0]
    weight = asked.column("times").to_numpy()[order] * idf[term[order]]
    return query.dictionary, np.searchsorted(term[order], np.arange(len(known) + 1)), query.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), weight


def _best_of_tasks(counted: DataFrame, query_id: StructField, query_ids: pa.Array, begin: np.ndarray, query: np.ndarray, weight: np.ndarray, mean_length: float, key: str, k: int | None) -> DataFrame:
    """query_id, key, score (and place) out of rows' counts. A task keeps k rows of each query, of equal scores those with the least keys."""
    n, times_of = len(query_ids), np.diff(begin)
    fields = [query_id, counted.schema[0], StructField("score", DoubleType()), StructField("rounded", DoubleType())]
    names = [f.name for f in fields]

    def scores(length: np.ndarray, edges: np.ndarray, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row per query, a column per row; 0 where they share no term."""
        owner = np.repeat(np.arange(len(length)), np.diff(edges))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean_length))
        times = times_of[ids]
        entry = np.arange(times.sum()) + np.repeat(begin[ids] - np.cumsum(times) + times, times)
        return -np.bincount(query[entry] * len(length) + np.repeat(owner, times), weight[entry] * np.repeat(part, times), n * len(length)).reshape(n, len(length))

    def cut(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, [("query", "ascending"), ("rounded", "ascending"), ("key", "ascending")]))
        own = found.column("query").to_numpy()
        return found.filter(pa.array(np.arange(len(own)) - np.searchsorted(own, own) < k))

    def told(found: pa.Table) -> Iterator[pa.RecordBatch]:
        out = pa.table([query_ids.take(found.column("query").combine_chunks()), found.column("key"), found.column("score"), found.column("rounded")], names=names)
        return iter(out.combine_chunks().to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bound = None, np.full(n, np.inf)
        for batch in batches:
            length, (ids, tf) = batch.column(1).to_numpy(), (batch.column(i).flatten().to_numpy() for i in (2, 3))
            edges = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(), dtype=np.int64))
            work = np.diff(np.append(0, np.cumsum(times_of[ids]))[edges])
            for a, b in _groups(np.maximum(work, n), SCORES_AT_ONCE):
                part, own = batch.slice(a, b - a), slice(edges[a], edges[b])
                score = scores(length[a:b], edges[a : b + 1], ids[own], tf[own])
                rounded = np.round(score, 9)
                hit = score < 0
                if k is not None:
                    least = np.minimum(bound, np.partition(rounded, k - 1, axis=1)[:, k - 1]) if part.num_rows >= k else bound
                    hit &= rounded <= least[:, None]
                at, row = np.nonzero(hit)
                found = pa.table([pa.array(at), part.column(0).take(pa.array(row)), pa.array(score[hit]), pa.array(rounded[hit])], names=["query", "key", "score", "rounded"])
                if k is None:
                    yield from told(found)
                elif len(at):
                    best = cut(found if best is None else pa.concat_tables([best, found]))
                    own = best.column("query").to_numpy()
                    last = np.flatnonzero(np.arange(len(own)) - np.searchsorted(own, own) == k - 1)
                    bound[own[last]] = best.column("rounded").to_numpy()[last]
        if best is not None:
            yield from told(best)

    found = counted.mapInArrow(run, StructType(fields))
    if k is None:
        return found.drop("rounded")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rounded", key))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("rounded")


def scored(hits: DataFrame, asked: DataFrame, total: DataFrame, key: str, k: int | None) -> DataFrame:
    """query_id, key, score and place of the k best rows, from postings (term, key, tf, length), asked terms and one row of totals (n_rows, mean_length)."""
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(frequency, "term").join(asked, "term").join(F.broadcast(total))
    idf = F.ln((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    weight = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scores = rows.groupBy("query_id", key).agg((-F.sum(weight)).alias("score"))
    if k is None:
        return scores
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), key))
    return scores.withColumn("place", place).filter(F.col("place") <= k)


def rerank(found: DataFrame, texts: DataFrame, key: str, mention: Column, k: int) -> DataFrame:
    """The k best of more candidates, those that mention something first, else in order of score."""
    rows = found.join(texts, key).withColumn("mentions", mention)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mentions"), F.round("score", 9), key))
    return rows.withColumn("place", place).filter(F.col("place") <= k)

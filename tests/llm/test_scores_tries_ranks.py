import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import prefix_trie, quality, ranked_search

SMALL = "/root/testdata/sf0.01"
CLASHING = ["_place", "rep", "label", "first", "n", "x", "fold", "y", "term", "terms", "id", "weight", "weights", "times", "key", "at", "pos", "base", "kind", "depth"]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def area(y, score):
    """The chance that a row of 1 scores above a row of 0, ties half."""
    ones, zeros = score[y == 1], score[y == 0]
    return np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs, labels).toPandas()
    assert sorted(found.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    own = found.merge(labels.toPandas(), on="doc_id")
    own = own[own.held_out]
    assert area(own.quality.to_numpy(), own.score.to_numpy()) > 0.97
    assert (own.predicted == own.quality).mean() > 0.95


def test_quality_learns_from_no_held_out_label_and_no_other_column(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    more = other.unionByName(spark.createDataFrame([(None, 0, 0), (10**9, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    again = clashing(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}).repartition(7))
    assert found == {r.doc_id: r.score for r in quality.quality_scores(again, more).collect()}


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string"
    odd = [(1, None), (2, ""), (3, "word " * 300_000), (None, "a b"), (4, "x" * 1_500_000), (5, "a b"), (5, "a b"), (6, "\0\n\n\t")]
    docs, kinds = spark.createDataFrame(odd, schema), "doc_id long, quality int"
    none = quality.quality_scores(docs, spark.createDataFrame([], kinds)).collect()
    assert len(none) == len(odd) and {r.score for r in none} == {0.5}
    ones = quality.quality_scores(docs, spark.createDataFrame([(d, 1) for d in (1, 2, 3, 4, 6, 7)], kinds)).collect()
    assert all(r.predicted == 1 and 0 <= r.score <= 1 for r in ones)
    both = quality.quality_scores(docs, spark.createDataFrame([(d, d % 2) for d in (1, 2, 3, 4, 6)] * 3 + [(4, 1)], kinds)).collect()
    assert len({r.score for r in both if r.doc_id in (1, 2)}) == 1 and len({r.score for r in both if r.doc_id == 5}) == 1
    assert [r.held_out for r in both if r.doc_id is None] == [False]
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame([(1, 1)], kinds)).count() == 0


def test_statistics_by_pieces_equal_those_of_the_whole(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choices(["word ", "two ", "THREE!! ", "a\n", "ä, ", "1.5 ", "|"], k=4000))
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 700)
    parts = dict(zip(quality.NAMES, np.abs(quality.statistics(text) - whole)))
    assert max(v for k, v in parts.items() if "line" not in k) < 1e-9 and max(parts.values()) < 0.3  # a cut ends a line


def test_cosines_approximate_a_gaussian_kernel():
    model = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)))
    x = np.random.default_rng(1).normal(size=(40, len(quality.NAMES)))
    phi = model.cosines(x * quality.STEP)[:, 1:] / quality.COSINE_STEP
    far = ((x[:, None] - x) ** 2).sum(-1) / (quality.WIDTH**2 * len(quality.NAMES))
    assert np.abs(phi @ phi.T / quality.FEATURES - np.exp(-far / 2)).mean() < 0.06


def test_isotonic_equals_the_extremes_of_means():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = rng.integers(0, 4, 25)
        y = np.array([rng.binomial(k, i / 25) for i, k in enumerate(n)])
        if not n.sum():
            continue
        found, some = quality.isotonic(y.astype(float), n), np.flatnonzero(n)
        for i in some:
            means = [[y[a : b + 1].sum() / n[a : b + 1].sum() for b in some if b >= i] for a in some if a <= i]
            assert abs(found[i] - max(map(min, means))) < 1e-12
        assert (np.diff(found) >= -1e-12).all()


def plain_trie(rows):
    """The trie of rows (conv_id, turn, role, text), one prefix after the other."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, turns in own.items()}
    talks = {c: tuple(own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + turns[h:]) for c, turns in own.items()}
    members = defaultdict(list)
    for c, talk in talks.items():
        for d in range(len(talk) + 1):
            members[talk[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[c] for c in children[p])
    ends = {p: ",".join(str(c) for c in sorted(m) if len(talks[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def talks(seed, n):
    rng, rows = random.Random(seed), [(None, 1, "user", "nobody's")]
    for c in range(n):
        if c == 100:  # a hundred's conversation that is missing
            continue
        for t in range(rng.choice([0, 1, 2, 3, 8, 12])):
            rows.append((-c if c % 7 == 0 else c, rng.choice([t, None, t]), rng.choice(["user", None]), rng.choice(["a", "b", None, "é"]) if t else "x"))
    rows += [(201, t, "user", f"long {t}") for t in range(300)] + [(c, t, "user", f"long {t}") for c in (200, 302, 308) for t in range(250)]
    return rows


@pytest.mark.parametrize("local, chain, piece", [(4096, 4096, 1 << 16), (12, 3, 2)])
def test_trie_equals_plain_prefixes(spark, monkeypatch, local, chain, piece):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "CHAIN", chain)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = talks(3, 320)
    if local < 100:  # a round per turn of the long copies is slow
        rows = [r for r in rows if (r[3] or "")[:5] != "long " or r[1] < 9]
    found = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    assert sorted(tuple(r) for r in found.collect()) == plain_trie(rows)


def test_trie_of_one_turnless_conversation_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, None, None)]
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()] == plain_trie(rows) and len(plain_trie(rows)) == 1
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []


def plain_ranks(docs, items, k):
    def terms(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked[i] = min(asked.get(i, text or ""), text or "", key=str.encode)
    found = []
    for i, text in asked.items():
        scores = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        found += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("vocabulary, held, entries", [(1 << 20, 1 << 22, 1 << 20), (7, 64, 40)])
def test_ranks_equal_plain_scores(spark, monkeypatch, vocabulary, held, entries):
    monkeypatch.setattr(ranked_search, "VOCABULARY", vocabulary)
    monkeypatch.setattr(ranked_search, "HELD", held)
    monkeypatch.setattr(ranked_search, "DOCUMENTS", held)
    monkeypatch.setattr(ranked_search, "ITEM_ENTRIES", entries)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ärger", "İ", "日本", "A1", "a1", "x²"]
    text = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(words, k=n))
    docs = [(d, text(rng.randint(1, 60))) for d in range(150)] + [(150, None), (151, ""), (152, "-- !"), (None, text(9)), (7, text(5)), (7, text(5)), (160, "w1 " * 90_000)]
    docs += [(161, "w3 w3"), (162, "w3 w3"), (163, "W3\0w3")]
    items = [(i, text(rng.randint(1, 15))) for i in range(30)] + [(30, None), (31, "nowhere"), (None, "w1"), (2, "w1 w1 w2"), (2, "w1 w1 w2"), (33, "w1 " * 50 + "w2")]
    found = ranked_search.ranked(
        clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), clashing(spark.createDataFrame(items, "item_id long, text string")), 6
    )
    assert sorted(tuple(r) for r in found.collect()) == plain_ranks(docs, items, 6)


def test_ranks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked(docs.limit(0), items).collect() == []
    assert ranked_search.ranked(docs, items.limit(0)).collect() == []
    assert [(r.item_id, r.rank, r.doc_id) for r in ranked_search.ranked(docs, items).collect()] == [(1, 1, 1)]


def test_terms_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 8)
    text = "Some words, aVeryLongWordThatPassesPieces and ÄÖ" * 20
    assert ranked_search.term_counts(text.encode()) == Counter(t.encode() for t in re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))

import base64
import hashlib
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import byte_bpe, packing, token_files
from quarry.llm.common import shared_dir

TEXTS = [(5, "plain words, plain words"), (1, None), (2, ""), (3, " \n\n  spaces \t and 'll don't  \n"), (4, "é中文 🎉 \x00 naïve"), (9, "same"), (9, "same"), (7, "w" * 3000 + " " + "ab " * 5000), (None, "no id")]
SCHEMA = "doc_id long, text string, start string, n_tokens string, length string"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(name, text, end):
    t = Tokenizer.from_file(P.path(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_round_trip(spark, tik):
    got = byte_bpe.round_trip_digest(frame(spark), P.path("byte_bpe_50k.tiktoken")).collect()
    want = []
    for doc, text in TEXTS:
        ids = np.array(tik.encode_ordinary(text or ""), "<u4")
        want.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(frame(spark), path)
    back = {(r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded, path).collect()}
    assert back == {(d, (t or "").encode()) for d, t in TEXTS}
    assert all(len(r.offsets) == len(r.ids) + 1 for r in encoded.collect())
    assert byte_bpe.encode(frame(spark, []), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'stmdrevl 1!?.\n\t　 ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_slices_equal_the_pattern(tik, text):
    global bpe
    if "bpe" not in globals():
        bpe = byte_bpe.ByteBpe(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    ids = np.frombuffer(next(bpe.encode_all([text])), "<u4")
    assert ids.tolist() == tik.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_long_words(tik):
    """Merges of words without a boundary take n log n: a million letters in seconds, with the library's ids."""
    rng = np.random.default_rng(2)
    bpe = byte_bpe.ByteBpe(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    for alphabet, n in (("ab", 3000), ("etaoinshrdlu", 3000), ("あいう", 1000), ("a", 4097)):
        word = "".join(rng.choice(list(alphabet), n))
        assert np.frombuffer(next(bpe.encode_all([word])), "<u4").tolist() == tik.encode_ordinary(word)
    begun = time.perf_counter()
    ids = np.frombuffer(next(bpe.encode_all([word := "".join(rng.choice(list("etaoinshrdlu"), 1_000_000))])), "<u4")
    assert time.perf_counter() - begun < 10 and bpe.decode(ids) == word.encode()


def test_special_tokens_in_texts(spark):
    """Their strings become their ids, as with the library's default, wherever they stand; with special_as_text they are text."""
    rng = np.random.default_rng(3)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "<|startoftext|>\n<|endoftext|> x", "a<|endoftext|>", "< |endoftext|>", "<|ENDOFTEXT|>"]
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "a", "Word", "don't", "é", ".", "<|", "  ", "12"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.token_file_digest(docs, P.path("byte_bpe_50k.json"), 0).collect()
    assert {r.doc_id: r.ids_crc32 for r in files} == {i: zlib.crc32(ids_of("byte_bpe_50k.json", t, 0).tobytes()) for i, t in enumerate(texts)}
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == {i: zlib.crc32(ids_of("word_bpe_49k.json", t, 2).tobytes()) for i, t in enumerate(texts)}
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    as_text = packing.pack(docs, P.path("word_bpe_49k.json"), special_as_text=True).collect()
    assert {r.doc_id: r.doc_tokens for r in as_text} == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_token_files(spark):
    got = token_files.token_file_digest(frame(spark), P.path("byte_bpe_50k.json"), 0).orderBy("start").collect()
    at = 0
    for (doc, text), r in zip(sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0]), got):
        ids = ids_of("byte_bpe_50k.json", text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(TEXTS) - 1
    assert token_files.token_file_digest(frame(spark, []), P.path("byte_bpe_50k.json"), 0).count() == 0


def test_wide_ids(spark):
    folder = shared_dir(spark, "wide")
    manifest = token_files.write_token_files(frame(spark), folder, P.path("byte_bpe_50k.json"), end_id=70_000)
    assert manifest.filter("wide").count() == manifest.count()
    assert token_files.read_token_files(spark, folder, manifest).count() == len(TEXTS) - 1


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(spark, size):
    got = packing.pack(frame(spark), P.path("word_bpe_49k.json"), size=size).toPandas()
    own = {}
    for doc, text in TEXTS:
        own[doc] = ids_of("word_bpe_49k.json", text, 2)
    rest = got[got.doc_id != 9]
    for doc, pieces in rest.groupby(rest.doc_id.fillna(-1)):
        ids, at = own[None if doc == -1 else int(doc)], 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert got[got.doc_id == 9].length.sum() == 2 * len(own[9])
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        ends = pieces.length.cumsum()
        assert (pieces.offset.values == np.append(0, ends.values[:-1])).all() and ends.iloc[-1] <= size
    assert packing.pack(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_patterns_hold_all_and_waste_little():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4095, rng.lognormal(6.5, 1, 20_000).astype(int) + 1)
    demand = np.bincount(-(-lengths // 16) - 1, minlength=256)
    patterns = packing.whole_patterns(demand, 256)
    assert (sum(n * p for p, n in patterns) == demand).all()
    assert all((p * np.arange(1, 257)).sum() <= 256 for p, _ in patterns)
    assert lengths.sum() / (4096 * sum(n for _, n in patterns)) > 0.98

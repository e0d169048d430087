"""Language identification by cross-parsing against suffix automata of labelled text.

Every language has a suffix automaton of a bounded sample of its labelled text. Reading a document, it
yields the longest match at every place; a document is parsed greedily into longest matches, and the
number of these phrases times the bits of a place in the sample, for each symbol, estimates the cross
entropy. The language that needs fewest wins.

Texts are lower-cased and every run of other characters than letters becomes one space; every letter of
any sample is a symbol. The automata are those of the reversed samples and read texts from behind, so that
the matches begin at a place and not end there. A text is read whole, in stretches of STRETCH symbols side by
side: each begins WARM symbols early, and again from further off while its match still spans all it has
read, so that the matches, and the phrases, are those of one reading from end to end.

A text is rejected by its parse against all languages together, where each phrase is the longest match in any
sample (so mixtures of learned languages stay): if its bits a symbol, with PRIOR symbols of the median
calibration text added to it, are more than the limit. The limit is REJECT times that median, or, if that
is more, SLACK times what the calibration texts and their short pieces need, and at least FLOOR bits. It holds
for every length.

Learned from: text and lang only, of rows whose crc32(doc_id as text) mod FOLDS is not HELD_OUT. The
sample is, for each label, at most SAMPLE_DOCS texts chosen by hash, of each a stretch of at most
SAMPLE_CHARS characters from a hashed place, and as many others for calibration. Every label is learned; the
model, about 1 MB a label, grows with the number of labels only, and a worker keeps the tables of KEPT_READERS.

Defined cases: a null text, or one without letters, is `und` with score 0 and is rejected; an empty table
gives no rows; ties go to the language first in the alphabet; repeated rows get the same result; without
labelled rows every text is `und`; very long texts are parsed whole; a null doc_id is never learned from and
counts as not held out; other columns do not matter, and drop_rejected keeps them.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of, worker_state, written

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, SAMPLE_CHARS = 96, 320
#: Symbols of a sample at most, so that a match's length fits 16 bits; 96 stretches of 320 characters stay below it.
SAMPLE_SYMBOLS = 32_000
#: A language's commonest letters have columns in its table; its rarer ones go through sorted edges.
DENSE = 62
STRETCH, WARM = 512, 32
#: Symbols that go through the automata at once.
GROUP_CHARS = 1 << 21
REJECT, SLACK, PRIOR, FLOOR = 1.85, 1.1, 16, 3.5
#: Languages whose tables (about 7 MB each) a worker keeps; of more, one at a time is made, so that memory stays within bounds.
KEPT_READERS = 24
#: More labels than these are joined by a shuffle.
MANY_LABELS = 20_000
PIECES = (8, 16, 32, 64, 128, 256)
UNDETERMINED = "und"
_OWN = np.int16(32_767)


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges as rows (state, symbol, target), and of each state its suffix link and length; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        current = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = current
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    rows = np.array([(s, c, t) for s, own in enumerate(edges) for c, t in own.items()] or np.zeros((0, 3)), np.int32).reshape(-1, 3)
    return rows, np.array(link, np.int32), np.array(length, np.int32)


class Reader:
    """An automaton as arrays that many places of a text go through side by side.

    Of a state and a column: the state after the symbol, suffix links followed where there is no edge, and
    the length that the match is cut to before the symbol joins it (_OWN: not at all; -1: nothing is left).
    """

    def __init__(self, edges: np.ndarray, link: np.ndarray, length: np.ndarray, symbols: int):
        self.link, self.length, self.symbols = link, length, symbols
        letters, counts = np.unique(edges[:, 1], return_counts=True)
        dense = np.sort(letters[np.argsort(-counts, kind="stable")[:DENSE]])
        self.width = len(dense) + 2
        self.rare, unknown = len(dense), len(dense) + 1
        self.columns = np.full(symbols, unknown, np.uint8)
        self.columns[letters] = self.rare
        self.columns[dense] = np.arange(len(dense))
        goto = np.full((len(link), self.width), -1, np.int32)
        cut = np.full((len(link), self.width), -1, np.int16)
        column = self.columns[edges[:, 1]]
        own = column < self.rare
        goto[edges[own, 0], column[own]] = edges[own, 2] * self.width
        cut[edges[own, 0], column[own]] = _OWN
        goto[0, goto[0] < 0] = 0
        depth, above = np.zeros(len(link), np.int32), link.copy()
        while (above >= 0).any():
            depth += above >= 0
            above = np.where(above >= 0, link[above], -1)
        order = np.argsort(depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]:
            up = link[level]
            none = goto[level] < 0
            cut[level] = np.where(none, np.minimum(cut[up], length[up, None]), cut[level])
            goto[level] = np.where(none, goto[up], goto[level])
        self.goto, self.cut = goto.reshape(-1), cut.reshape(-1)
        rest = edges[~own]
        key = rest[:, 0].astype(np.int64) * symbols + rest[:, 1]
        self.keys, self.targets = np.sort(key), rest[np.argsort(key, kind="stable"), 2]

    def step(self, state: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (times width) and match lengths after one more symbol each."""
        column = self.columns[symbol]
        place = state + column
        new, size = self.goto[place], np.minimum(length, self.cut[place]) + np.int16(1)
        if len(self.keys) and (rare := np.flatnonzero(column == self.rare)).size:
            s, n = state[rare] // self.width, length[rare].copy()
            new[rare], size[rare] = 0, 0
            while rare.size:
                key = s.astype(np.int64) * self.symbols + symbol[rare]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                new[rare[hit]], size[rare[hit]] = self.targets[at[hit]] * self.width, n[hit] + 1
                on = ~hit & (s > 0)
                rare, s = rare[on], self.link[s[on]]
                n = np.minimum(n[on], self.length[s]).astype(np.int16)
        return new, size


class Stretches:
    """Where the stretches of some texts lie among their symbols, and the symbols that they read, step by step."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.symbols = symbols
        pieces = -(-counts // STRETCH)
        ends = np.repeat(np.cumsum(counts), pieces)
        rank = np.repeat(np.cumsum(pieces), pieces) - 1 - np.arange(int(pieces.sum()))  # the text's last stretch is 0 and begins nowhere before
        self.after = rank * STRETCH  # symbols of the text behind the stretch
        self.last = ends - self.after - 1
        self.size = np.minimum(np.repeat(counts, pieces) - self.after, STRETCH)
        self.order = np.argsort(-self.size, kind="stable")
        last, size = self.last[self.order], self.size[self.order]
        active = np.searchsorted(-size, -np.arange(STRETCH), side="left")  # stretches longer than j
        self.rows = [symbols[last[:k] - j] for j, k in enumerate(active.tolist()) if k]

    def match_lengths(self, reader: Reader) -> np.ndarray:
        """Of every symbol, in order, the length of the longest match that begins there."""
        state, length = np.zeros(len(self.size), np.int32), np.zeros(len(self.size), np.int16)
        todo, warm = np.flatnonzero(self.after), WARM
        while todo.size:
            w = np.minimum(self.after[todo], warm)
            s, n = np.zeros(len(todo), np.int32), np.zeros(len(todo), np.int16)
            for j in range(int(w.max()), 0, -1):
                on = np.flatnonzero(w >= j)
                s[on], n[on] = reader.step(s[on], n[on], self.symbols[self.last[todo[on]] + j])
            state[todo], length[todo] = s, n
            todo, warm = todo[(n == w) & (w < self.after[todo])], 8 * warm
        state, length = state[self.order], length[self.order]
        found = np.zeros((STRETCH, len(self.size)), np.int16)
        for j, row in enumerate(self.rows):
            k = len(row)
            state[:k], length[:k] = reader.step(state[:k], length[:k], row)
            found[j, :k] = length[:k]
        by_lane = np.empty((len(self.size), STRETCH), np.int16)
        by_lane[self.order] = found.T
        return by_lane[:, ::-1][np.arange(STRETCH)[::-1] < self.size[:, None]]


def phrases(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text the number of phrases of its greedy parse; a symbol without a match is one by itself."""
    steps = memoryview(np.maximum(lengths, 1))
    found, at = [], 0
    for end in np.cumsum(counts).tolist():
        n = 0
        while at < end:
            at += steps[at]
            n += 1
        found.append(n)
    return np.array(found, np.int64)


class Model:
    """Alphabet, and for each language its automaton and the bits of a place in its sample."""

    def __init__(self, samples: dict[str, list[str]]):
        self.key = uuid.uuid4().hex
        self.languages = sorted(samples)
        self.letters = "".join(sorted({c for texts in samples.values() for x in texts for c in x.lower() if c.isalpha()}))
        self.automata, self.bits, self.total_bits = [], [], 0.0
        self.limit, self.median = np.inf, 0.0
        total = 0
        for language in self.languages:
            symbols = self.symbols(samples[language])[0][:SAMPLE_SYMBOLS]
            self.automata.append(suffix_automaton(symbols[::-1].tolist()))
            self.bits.append(float(np.log2(max(2, len(symbols)))))
            total += len(symbols)
        self.total_bits = float(np.log2(max(2, total)))

    def calibrate(self, texts: list[str]) -> None:
        """The limit of what is kept, from texts that were not learned from, whole and cut into pieces."""
        whole, n = self.parse(texts)[1:]
        if not self.languages or not (n > 0).any():
            return
        self.median = float(np.median(whole[n > 0] / n[n > 0]))
        pieces = [x[i : i + size] for x in texts for size in PIECES for i in (0, len(x) // 2) if len(x) >= size]
        need = [self.needed(*self.parse(group)[1:]) for group in (texts, pieces)]
        self.limit = max(FLOOR, REJECT * self.median, SLACK * max(float(np.quantile(x, 0.995)) for x in need if len(x)))

    def needed(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (bits + PRIOR * self.median) / (n + PRIOR)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("readers", "codes")}

    def _codes(self) -> np.ndarray:
        """Symbol of each code point: 0 for what is no letter, the last for a letter of no sample."""
        if "codes" not in self.__dict__:
            codes = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000).astype(np.int32) * (len(self.letters) + 1)
            codes[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
            self.codes = codes
        return self.codes

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each begun by one space, and how many each has; runs of spaces are one."""
        lower = [" " + x.lower() for x in texts]
        lengths = np.array([len(x) for x in lower], np.int64)
        found = self._codes()[np.frombuffer("".join(lower).encode("utf-32-le"), "<u4")]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] > 0) | (found[:-1] > 0)
        begins = np.cumsum(lengths) - lengths
        keep[begins] = True
        return found[keep], np.add.reduceat(keep, begins) if len(texts) else lengths

    def _readers(self) -> Iterator[Reader]:
        """The languages' tables in turn: KEPT_READERS of them are kept, those of more languages are made for each group of texts."""
        if "readers" not in self.__dict__:
            self.readers = [Reader(*a, len(self.letters) + 2) for a in self.automata[:KEPT_READERS]]
        yield from self.readers
        for a in self.automata[KEPT_READERS:]:
            yield Reader(*a, len(self.letters) + 2)

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text under each language, under all together, and the texts' numbers of symbols (0 without letters)."""
        bits = np.zeros((len(texts), len(self.languages)))
        if not texts or not self.languages:
            return bits, np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        symbols, counts = self.symbols(texts)
        stretches = Stretches(symbols, counts)
        longest = np.zeros(len(symbols), np.int16)
        for column, (reader, weight) in enumerate(zip(self._readers(), self.bits)):
            own = stretches.match_lengths(reader)
            bits[:, column] = phrases(own, counts) * weight
            np.maximum(longest, own, out=longest)
        letters = np.add.reduceat(symbols > 0, np.cumsum(counts) - counts)
        return bits, phrases(longest, counts) * self.total_bits, np.where(letters > 0, counts, 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 (1 less the best over the second best), and whether the text is rejected."""
        if not texts or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, together, n = self.parse(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.full(len(texts), np.inf)
        known = n > 0
        score = np.where(known, np.clip(1 - low / np.maximum(second, 1e-12), 0, 1), 0.0)
        return [self.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist())], score, ~known | (self.needed(together, n) > self.limit)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample: counts of labels first, then rows below a hash limit for each label."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(known.groupBy("lang").count(), "labels")
    if counts.count() <= MANY_LABELS:  # a row of a few bytes each
        counts = F.broadcast(counts)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows = known.join(counts, "lang").filter(share < 6.0 * SAMPLE_DOCS / F.col("count"))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    rows = rows.select("lang", F.xxhash64("doc_id").alias("place"), F.substring("text", (begin + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).filter(F.col("rank") <= 2 * SAMPLE_DOCS)
    samples: dict[str, list[str]] = {}
    other: list[str] = []
    for r in rows.orderBy("lang", "rank").collect():  # at most 2 * SAMPLE_DOCS short stretches a label
        if r["rank"] % 2:
            samples.setdefault(r["lang"], []).append(r["text"])
        else:
            other.append(r["text"])
    model = Model(samples)
    model.calibrate(other)
    return model


def _predictions(key: str, shared, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """predict over groups of texts of bounded size; the worker keeps the model's tables."""
    own = worker_state(key, lambda: shared.value)
    languages, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
    group, size = [], 0
    for text in itertools.chain(texts_of(column), [None]):
        if group and (text is None or size + len(text) > GROUP_CHARS):
            found = own.predict(group)
            languages += found[0]
            scores.append(found[1])
            rejected.append(found[2])
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)
    return languages, np.concatenate(scores), np.concatenate(rejected)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, rejected."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key  # bounded by the number of labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, rejected = _predictions(key, shared, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    shared, key, text_at = docs.sparkSession.sparkContext.broadcast(model), model.key, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_predictions(key, shared, batch.column(text_at))[2]))

    return docs.mapInArrow(run, docs.schema)

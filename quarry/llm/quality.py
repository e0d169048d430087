"""Quality scores: random Fourier features of document statistics, a ridge fit, isotonic calibration.

Every whole text becomes NAMES statistics (lengths, shares of character classes, words, repeats, lines), read in
pieces of PIECE characters. Cosines of random projections of the standardised statistics approximate a Gaussian
kernel; the normal equations of a ridge regression on the labels are summed by the tasks, each over its rows,
and solved on the driver, where they have a fixed size. The scores of the calibration fold are counted in BINS
bins and made monotone by pooling adjacent violators.

Learned from: text, and labels of rows whose crc32(doc_id as text) mod FOLDS is not HELD_OUT; all of them, no
sample. Fold CALIBRATION calibrates, the others fit. Statistics and cosines are rounded to fixed steps and their
sums are integers, so a model does not depend on how the rows are dealt out or which tasks ran twice.

Defined cases: a null text counts as empty and is scored like any other; an empty table gives no rows; repeated
rows get the same result; a doc_id with several labels counts as their mean, a label without document or without
quality not at all, a quality above 0 as 1; a null doc_id is never learned from and counts as not held out;
without labels every score is 0.5, with labels of one kind near that one; without rows in the calibration fold
the fitted rows calibrate; ties in the score are ties in the statistics or lie in one bin and differ by less than
BLEND; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_of, worker_state, written

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-4, 1.0, 11
#: Steps of a statistic and of a cosine; a statistic is at most MOST.
STEP, COSINE_STEP, MOST = 1 << 16, 1 << 12, 32.0
LOW, BINS, BIN = -1.0, 3072, 1 / 1024
#: Share of the uncalibrated score in the result, so that scores within a bin keep their order.
BLEND = 0.001
PIECE = 1 << 20
THRESHOLD = 0.3

NAMES = (
    "chars", "words", "lines", "lower", "upper", "caseless", "digit", "space", "newline", "stop", "comma", "call", "mark", "symbol", "control",
    "capitals", "word_length", "word_spread", "long_words", "distinct", "most_common", "repeated_next", "bare_words", "odd_words",
    "line_length", "repeated_lines", "ended_lines", "longest_run",
)
#: Classes of characters, in the order of their shares in NAMES.
_CLASSES = NAMES[3:15]
_ENDS = re.compile(r"[.!?:;,)\"'»”]\s*$")


def _classes() -> np.ndarray:
    """The class of every code point."""

    def kind(c: str) -> str:
        if c.islower():
            return "lower"
        if c.isupper():
            return "upper"
        if c.isalpha():
            return "caseless"
        if c.isdigit():
            return "digit"
        if c == "\n":
            return "newline"
        if c.isspace():
            return "space"
        named = {".": "stop", ",": "comma", "!": "call", "?": "call", **dict.fromkeys(";:'\"()-«»“”‘’–—¿¡", "mark")}
        return named.get(c, "symbol" if c.isprintable() else "control")

    place = {name: i for i, name in enumerate(_CLASSES)}
    return np.fromiter((place[kind(chr(i))] for i in range(0x110000)), np.uint8, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut before a space or a line's end where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > 0 else end
        yield text[at:end]
        at = end


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text, in the order of NAMES."""
    table = worker_state("quality classes", _classes)
    counts, words, lines = np.zeros(len(_CLASSES), np.int64), Counter(), Counter()
    sizes = np.zeros(3)  # words, their lengths, squares of these
    longer = bare = odd = follows = longest = ended = 0
    last_word = None
    for piece in _pieces(text):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        counts += np.bincount(table[points], minlength=len(_CLASSES))
        changes = np.flatnonzero(np.diff(points)) + 1
        longest = max(longest, int(np.diff(np.concatenate([[0], changes, [len(points)]])).max()))
        own = piece.split()
        if own:
            length = np.fromiter(map(len, own), np.int64, len(own))
            sizes += (len(own), length.sum(), (length.astype(float) ** 2).sum())
            longer += int((length >= 15).sum())
            follows += sum(map(str.__eq__, own, [last_word or "", *own[:-1]]))
            last_word = own[-1]
            words.update(own)
        for line in piece.split("\n"):
            if line.strip():
                lines[hash(line)] += 1
                ended += bool(_ENDS.search(line[-8:]))
    for word, n in words.items():
        bare += n * word.isalpha()
        odd += n * (not any(map(str.isalnum, word)))
    chars, n_words, n_lines = int(counts.sum()), sizes[0], sum(lines.values())
    letters = counts[:3].sum()
    one, each, line = max(1, chars), max(1, n_words), max(1, n_lines)
    mean = sizes[1] / each
    return np.array([
        np.log1p(chars), np.log1p(n_words), np.log1p(n_lines), *(np.sqrt(counts / one)),
        counts[1] / max(1, letters), np.log1p(mean), np.log1p(np.sqrt(max(0, sizes[2] / each - mean**2))), longer / each,
        np.log1p(len(words)) / np.log1p(each) if n_words else 0, max(words.values(), default=0) / each, follows / each, bare / each, odd / each,
        np.log1p(chars / line), 1 - len(lines) / line if n_lines else 0, ended / line, np.log1p(longest),
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold and the statistics in whole steps, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.rint(np.clip(statistics(x), -MOST, MOST) * STEP).astype(np.int32) for x in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "fold", "x"])

    doc_id = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return docs.select(doc_id.alias("doc_id"), fold.cast("int").alias("fold"), text_of().alias("text")).mapInArrow(run, "doc_id long, fold int, x array<int>")


class Model(NamedTuple):
    """Standardisation, projections, ridge weights (the first of the constant) and the calibrated score of each bin."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """A constant and the random Fourier features, in whole steps."""
        random = np.random.default_rng(SEED)
        turn = random.normal(size=(len(NAMES), FEATURES)) / (WIDTH * np.sqrt(len(NAMES)))
        z = (x / STEP - self.mean) / self.scale
        cosine = np.sqrt(2) * np.cos(np.clip(z, -8, 8) @ turn + random.uniform(0, 2 * np.pi, FEATURES))
        return np.hstack([np.full((len(x), 1), float(COSINE_STEP)), np.rint(cosine * COSINE_STEP)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The ridge score, rounded so that it is the same in batches of any size."""
        return np.round(self.cosines(x) @ self.weights, 9)

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - LOW) / BIN, 0, BINS - 1).astype(np.int32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        plain = 1 / (1 + np.exp(-4 * np.clip(raw - 0.5, -8, 8)))
        return (1 - BLEND) * self.calibrated[self.bins(raw)] + BLEND * plain


def _grid(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(NAMES)).astype(float)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of all cosines with each other and with y; each task sums its rows, Spark the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                phi = model.cosines(_grid(batch.column(0)))
                both = np.hstack([phi, np.rint(np.asarray(batch.column(1)) * COSINE_STEP)[:, None]])
                total += (phi.T @ both).astype(np.int64)  # whole numbers below 2^53, so exact
        i, j = np.triu_indices(FEATURES + 1, 0, FEATURES + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    found = rows.select("x", "y").mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # a fixed number of rows
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    total[found["i"], found["j"]] = found["s"]
    square = np.triu(total[:, :-1])
    return square + np.triu(square, 1).T, total[:, -1]


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest the means y / n of bins, by pooling adjacent violators; empty bins between take from both sides."""
    blocks: list[list[float]] = []  # sum, count, first bin, last bin
    for i in np.flatnonzero(n).tolist():
        blocks.append([float(y[i]), float(n[i]), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    at = [x for b in blocks for x in b[2:]]
    return np.interp(np.arange(len(n)), at, [b[0] / b[1] for b in blocks for _ in (0, 1)])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from the statistics of all labelled rows that are not held out."""
    quality = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    y = quality.agg(F.avg((F.col("quality") > 0).cast("double")).alias("y"))
    rows = written(stats.filter(F.col("doc_id").isNotNull() & (F.col("fold") != HELD_OUT)).join(y, "doc_id").select("x", "y", "fold"), "labelled")
    places = range(len(NAMES))
    whole = [F.get("x", F.lit(i)).cast("decimal(38,0)") for i in places]
    sums = rows.agg(F.count("*"), *(F.sum(c) for c in whole), *(F.sum((c * c).cast("decimal(38,0)")) for c in whole), F.sum((F.col("fold") == CALIBRATION).cast("long"))).first()
    if not sums[0]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    n, mean = sums[0], np.array([float(sums[1 + i]) for i in places]) / sums[0]
    spread = np.sqrt(np.maximum(0, np.array([float(sums[1 + len(NAMES) + i]) for i in places]) / n - mean**2))
    model = Model(mean / STEP, np.maximum(spread / STEP, 1e-3))
    both = 0 < sums[-1] < n
    square, target = normal_equations(rows.filter(F.col("fold") != CALIBRATION) if both else rows, model)
    weights = np.linalg.solve(square + RIDGE * max(1.0, square[0, 0]) * np.eye(FEATURES + 1), target)
    model = model._replace(weights=weights / COSINE_STEP)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, n = np.zeros(BINS), np.zeros(BINS, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = model.bins(model.raw(_grid(batch.column(0))))
                y += np.bincount(own, np.rint(np.asarray(batch.column(1)) * COSINE_STEP), BINS)
                n += np.bincount(own, minlength=BINS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(y[some].astype(np.int64)), pa.array(n[some])], ["bin", "y", "n"])

    shown = rows.filter(F.col("fold") == CALIBRATION) if both else rows
    found = shown.select("x", "y").mapInArrow(binned, "bin int, y long, n long").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas()  # BINS rows at most
    y, n = np.zeros(BINS), np.zeros(BINS)
    y[found["bin"]], n[found["bin"]] = found["y"], found["n"]
    return model._replace(calibrated=isotonic(y / COSINE_STEP, n))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_grid(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.col("fold") == HELD_OUT, F.lit(False))
    return stats.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of their labels; texts are read once, their statistics written."""
    stats = written(document_statistics(docs), "statistics")
    return score(stats, fit(stats, labels))

"""Secrets in texts: fixed patterns, and a character convolutional network over every other candidate.

Base findings come from three patterns and always stay. Any other run of CANDIDATE characters with a letter is a
candidate, but for words of fewer than LONG characters: letters of one case after the first two. The network reads its characters and the text around it. A run longer than INSIDE is
read whole, in pieces of INSIDE characters that begin every SLIDE characters, and the largest probability counts
(at most three pieces of a run are trained on).

The network is trained in numpy on labelled findings of the candidates' own shape. Positive are the
values of base findings, cut out of their keyword, so that what is left looks like any bare candidate.
Negative are candidates that pass a check: letters of one case that read as a word (WORD). What no pattern and no check decides is never trained on. At most SAMPLE windows
of a label are taken by hash over all documents, and a made starting set (starting_set: keys of many
kinds, and words, paths, numbers and names) is always added, so that there is a network for every table,
be it empty. A third is kept out of the training for calibration (Platt scaling with a prior) and for the
thresholds, one for each class of lengths (CLASSES): the highest at which RECALL of the class's positives in the
calibration are caught. What they reach there is kept as network.recall and network.false_rate, by class.

Spans are code points, end exclusive; kinds are assign, access, hex and cnn (added by the network; never
where it overlaps a base span).

Defined cases: a null or empty text has no spans; an empty table gives no rows; repeated rows and ties
get the same spans; very long texts are scanned whole; a null doc_id is carried along; other columns do
not matter to scan and are kept by redact.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import itertools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_of, written

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
LONG = 16
LETTER = re.compile("[A-Za-z]")
#: Lengths at which a class of candidates with a threshold of its own begins.
CLASSES = (8, 12, 16, 24)
#: Checked negatives: a word, of one case after the first two letters, with a vowel among any five letters.
WORD = re.compile(r"(?:[A-Z]{0,2}[a-z]+|[A-Z]+)")
CONSONANTS = re.compile(r"[^aeiouyAEIOUY]{5}")
#: Characters of the window: context, the candidate's characters, context; and from one piece of a long candidate to the next.
BEFORE, INSIDE, AFTER = 24, 48, 16
SLIDE = INSIDE // 2
#: What made words are put together from, besides single consonants.
CLUSTERS = ("bl", "ch", "cl", "cr", "fr", "gl", "gr", "kn", "ph", "pl", "pr", "qu", "sch", "sh", "sp", "st", "str", "th", "tr", "wh")
VOWELS = (*"aeiouaeiouaeiouy", "ai", "ea", "ee", "ie", "io", "oo", "ou")
ENDINGS = ("ch", "cht", "ck", "ct", "dge", "ght", "gy", "lk", "ll", "lt", "mp", "nce", "nd", "ng", "nt", "pf", "pt", "rk", "rm", "rst", "ss", "st", "ted", "tz")
WINDOW = BEFORE + INSIDE + AFTER
#: Windows that a task trains on, and the starting set's size.
SHARE, STARTING = 4_000, 4_000
#: Logits are counted in steps of 1 / FINE within LIMIT; weights are summed in steps of 1 / WEIGHT.
FINE, LIMIT, WEIGHT = 64, 50, 1 << 24
#: Share of the positives that each class's threshold catches.
RECALL = (0.92, 0.94, 0.97, 0.98)
FILTERS, WIDTH, EMBED, BATCH = 24, 5, 12, 128
#: Steps of the training on the starting set, and of that on what the documents hold besides.
STEPS, MORE_STEPS = 600, 150


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base findings, in order."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that spans, ascending by start, cover: disjoint and ascending."""
    found: list[tuple[int, int]] = []
    for a, _, b in spans:
        if found and a <= found[-1][1]:
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


def is_plain(run: str) -> bool:
    """A number, or a word of fewer than LONG letters, of one case after the first two."""
    return len(run) < LONG and run.isalpha() and (run[2:].islower() or run.isupper()) or LETTER.search(run) is None


def length_class(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, length, side="right") - 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates that meet no base span, in one pass over both lists."""
    taken = covered(base)
    at = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if is_plain(m[0]):
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            yield a, b


def is_checked_negative(run: str) -> bool:
    return WORD.fullmatch(run) is not None and CONSONANTS.search(run) is None


def labelled_values(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(where the context before it ends, start, end) of each base finding's value: keyword, signs and quotes in front are left out."""
    assigned = [(m.start(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(k == 0 for _, k, _ in base) else []
    yield from assigned
    at = 0
    for a, kind, b in base:
        if kind:
            while at < len(assigned) and assigned[at][2] <= a:
                at += 1
            inside = at < len(assigned) and assigned[at][0] <= a
            yield (assigned[at][0] if inside else a), a, b


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of INSIDE characters that a run is read in; the last one ends with the run."""
    last = max(start, end - INSIDE)
    return [(a, min(end, a + INSIDE)) for a in (*range(start, last, SLIDE), last)]


def trained_pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The first, middle and last piece."""
    own = pieces(start, end)
    return [own[i] for i in sorted({0, len(own) // 2, len(own) - 1})]


def window(text: str, start: int, end: int, context_end: int | None = None) -> np.ndarray:
    """Classes of the window's characters: 0 for nothing, ASCII as itself, 127 for others. context_end: where the context before it ends, if not at start."""
    cut = start if context_end is None else context_end
    parts = (text[max(0, cut - BEFORE) : cut].rjust(BEFORE, "\0"), text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    return np.minimum(codes, 127).astype(np.uint8)


def starting_set(n: int = STARTING, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels (1 keys, 0 others), n of each, all made from seed."""
    rng = random.Random(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits

    def any_of(signs: str, low: int, high: int) -> str:
        return "".join(rng.choices(signs, k=rng.randint(low, high)))

    def word(syllables: int) -> str:
        return "".join(rng.choice(("", *"bcdfghjklmnprstvwz", *CLUSTERS)) + rng.choice(VOWELS) + rng.choice(("", "", *"dglmnprstwx", *ENDINGS)) for _ in range(syllables))

    def words(count: int) -> list[str]:
        return [word(rng.randint(1, 4)) for _ in range(count)]

    def grouped_digits(sizes: tuple[int, ...], between: str) -> str:
        return between.join(any_of(digits, k, k) for k in sizes)

    def cased(n: int) -> str:
        return "".join(w.capitalize() for w in words(n))

    mixed = upper + lower + digits
    keys = (
        lambda: any_of(mixed, 16, 64),
        lambda: any_of(mixed, 20, 44),
        lambda: any_of(mixed + "+/", 24, 86) + rng.choice(("", "=", "==")),
        lambda: any_of(mixed + "-_", 20, 64),
        lambda: any_of("0123456789abcdef", 16, 64),
        lambda: any_of("0123456789abcdef", 16, 32),
        lambda: any_of(mixed, 16, 24),
        lambda: any_of("0123456789ABCDEF", 16, 64),
        lambda: any_of(upper + digits, 16, 40),
        lambda: any_of(lower + digits, 16, 40),
        lambda: any_of(upper + lower, 16, 48),
        lambda: any_of(lower, 2, 4) + rng.choice("_-") + any_of(mixed, 20, 44),
        lambda: "eyJ" + any_of(mixed + "-_", 30, 90),
    )
    short_keys = (
        lambda: any_of(mixed, 8, 11),
        lambda: any_of(mixed, 12, 15),
        lambda: any_of(mixed, 8, 15),
        lambda: any_of(upper + lower, 8, 11),
        lambda: any_of(upper + lower, 12, 15),
        lambda: any_of(lower + digits, 8, 15),
        lambda: any_of(upper + digits, 8, 15),
        lambda: any_of("0123456789abcdef", 8, 15),
        lambda: any_of(mixed + "+/", 8, 15),
        lambda: any_of(mixed + "-_", 8, 15),
    )
    others = (
        lambda: word(rng.randint(6, 14)),
        lambda: word(rng.randint(6, 12)).upper(),
        lambda: word(rng.randint(6, 12)).capitalize(),
        lambda: rng.choice("_-/").join(words(rng.randint(3, 6))),
        lambda: "/" + "/".join(words(rng.randint(2, 5))),
        lambda: cased(rng.randint(2, 5)),
        lambda: rng.choice("_-").join(words(2)) + rng.choice(("", "_", "-")) + any_of(digits, 1, 4),
        lambda: word(3) + any_of(digits, 1, 4),
        lambda: any_of(digits, 1, 4) + word(3),
        lambda: grouped_digits((4, 2, 2), "-") + "T" + any_of(digits, 2, 6) + "Z",
        lambda: rng.choice(upper) * rng.randint(16, 30),
        lambda: "-".join(any_of("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: word(2) + "=" + rng.choice((word(3), any_of(digits, 1, 6))) + rng.choice(("", "-x" + any_of(digits, 1, 2))),
    )
    short_others = (
        lambda: rng.choice("_-/").join(words(2)),
        lambda: rng.choice("_-/").join(words(rng.randint(2, 3))).upper(),
        lambda: cased(rng.randint(2, 3)),
        lambda: words(1)[0] + cased(rng.randint(1, 2)),
        lambda: word(rng.randint(1, 3)) + rng.choice(("", "", "_", "-")) + any_of(digits, 1, 4),
        lambda: word(rng.randint(1, 2)).upper() + rng.choice(("", "-", "_")) + any_of(digits, 2, 5),
        lambda: any_of(digits, 1, 4) + rng.choice(("", "-")) + word(rng.randint(1, 3)),
        lambda: grouped_digits((4, 2, 2), "-") + rng.choice(("Z", "T", "T" + any_of(digits, 2, 2))),
        lambda: rng.choice("=-/_+") + rng.choice("_-/=").join(words(rng.randint(1, 2))),
        lambda: "-".join(w.capitalize() for w in words(2)),
        lambda: word(1) + "=" + rng.choice((word(2), any_of(digits, 2, 5))),
        lambda: "v" + grouped_digits((1, 2, 2), rng.choice("-_")) + rng.choice(("", "-rc1", "-beta")),
    )

    def made(maker, short: bool) -> str:
        """What is a candidate, and of the lengths asked for."""
        while True:
            value = maker()
            if (8 <= len(value) < LONG if short else len(value) >= LONG) and not is_plain(value):
                return value

    windows = []
    for long_makers, short_makers in ((others, short_others), (keys, short_keys)):
        for i in range(n):
            makers = short_makers if i % 2 else long_makers
            value = made(makers[i // 2 % len(makers)], bool(i % 2))
            before = rng.choice((" ", " ", ". ", "\n", ": ", ' "', "(")).join([" ".join(words(6)), ""])
            if i % 10 in (4, 8):  # what ends a longer run
                before += rng.choice("-/_=").join([*words(rng.randint(2, 9)), ""])
            text = before + value + rng.choice((" ", ", ", ". ", "\n", '" ', ") ", "/")) + " ".join(words(4))
            a, b = rng.choice(trained_pieces(len(before), len(before) + len(value)))
            windows.append(window(text, a, b))
    return np.stack(windows), np.repeat([0, 1], n)


class CharNetwork:
    """Embedding, one convolution with ReLU, maximum over places and mean inside the candidate, one output; then a calibrated probability."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (128, EMBED)).astype(np.float32)
        self.kernel = rng.normal(0, 1 / np.sqrt(WIDTH * (EMBED + 1)), (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 1 / np.sqrt(FILTERS), 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0
        self.thresholds = np.full(len(CLASSES), 0.5)
        self.recall = self.false_rate = np.full(len(CLASSES), np.nan)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        inside = np.zeros((*x.shape, 1), np.float32)
        inside[:, BEFORE : BEFORE + INSIDE] = 1
        signal = np.concatenate([self.embed[x], inside], axis=2)
        return np.lib.stride_tricks.sliding_window_view(signal, WIDTH, axis=1).swapaxes(2, 3).reshape(len(x), x.shape[1] - WIDTH + 1, -1)

    @staticmethod
    def _share(x: np.ndarray) -> np.ndarray:
        """Of each place its weight in the mean: places whose middle is one of the candidate's characters."""
        own = np.zeros(x.shape, np.float32)
        own[:, BEFORE : BEFORE + INSIDE] = x[:, BEFORE : BEFORE + INSIDE] > 0
        own = own[:, WIDTH // 2 : x.shape[1] - WIDTH // 2]
        return own / np.maximum(own.sum(axis=1, keepdims=True), 1)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        columns, share = self._columns(x), self._share(x)
        act = np.maximum(columns @ self.kernel + self.bias, 0)
        features = np.concatenate([act.max(axis=1), np.einsum("bpf,bp->bf", act, share)], axis=1)
        return columns, share, act, features

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])[3] @ self.out + self.shift[0] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6, steps: int | None = None, rate: float = 0.01, whole: bool = False) -> None:
        """Adam on balanced batches; with whole, each side's rows are dealt out before any comes again, and steps rise until all have come."""
        steps = steps or STEPS
        rng = np.random.default_rng(seed)
        weights = [self.embed, self.kernel, self.bias, self.out, self.shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        sides = [np.flatnonzero(y == k) for k in (0, 1)]
        if whole:
            steps = max(steps, -(-max(map(len, sides)) // (BATCH // 2)))
            rounds = [-(-steps * (BATCH // 2) // len(side)) for side in sides]
            sides = [np.concatenate([rng.permutation(side) for _ in range(n)]) for side, n in zip(sides, rounds)]
        for step in range(1, steps + 1):
            at = slice((step - 1) * (BATCH // 2), step * (BATCH // 2))
            rows = np.concatenate([s[at] if whole else rng.choice(s, BATCH // 2) for s in sides])
            xs, ys = x[rows], y[rows].astype(np.float32)
            columns, share, act, features = self._forward(xs)
            error = (1 / (1 + np.exp(-np.clip(features @ self.out + self.shift[0], -50, 50))) - ys) / len(ys)
            back = share[:, :, None] * self.out[FILTERS:]  # of each activation, by its part in mean and maximum
            np.put_along_axis(back, place := act.argmax(axis=1)[:, None, :], np.take_along_axis(back, place, 1) + self.out[:FILTERS], 1)
            back = (back * error[:, None, None] * (act > 0)).astype(np.float32)
            d_kernel = np.tensordot(columns, back, ((0, 1), (0, 1)))
            d_columns = (back @ self.kernel.T).reshape(*back.shape[:2], WIDTH, EMBED + 1)[..., :EMBED]
            d_signal = np.zeros((*xs.shape, EMBED), np.float32)
            for k in range(WIDTH):
                d_signal[:, k : k + back.shape[1]] += d_columns[:, :, k]
            flat = xs.reshape(-1)
            d_embed = np.stack([np.bincount(flat, d, 128) for d in d_signal.reshape(-1, EMBED).T], axis=1)
            for w, g, m, v in zip(weights, (d_embed, d_kernel, back.sum(axis=(0, 1)), error @ features, error.sum(keepdims=True)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in (self.embed, self.kernel, self.bias, self.out, self.shift)])

    @weights.setter
    def weights(self, flat: np.ndarray) -> None:
        for w in (self.embed, self.kernel, self.bias, self.out, self.shift):
            w[...], flat = flat[: w.size].reshape(w.shape), flat[w.size :]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.calibrate_on(self.logits(x).astype(float), y, lengths_of(x), np.ones(len(x), np.int64))

    def calibrate_on(self, z: np.ndarray, y: np.ndarray, own: np.ndarray, n: np.ndarray) -> None:
        """Of logits, labels and length classes that stand for n windows each: Platt scaling, then the recall-constrained threshold.

        Newton's method on smoothed targets with a normal prior about scale 1 and offset 0, which keeps both
        finite where the network separates the labels; a step that does not lower the loss is halved.
        """
        good, bad = int(n[y == 1].sum()), int(n[y == 0].sum())
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        design, prior, start = np.stack([z, np.ones_like(z)], axis=1), 0.5, np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            s = design @ w
            return float((n * (np.logaddexp(0, s) - target * s)).sum() + prior * ((w - start) ** 2).sum() / 2)

        w, now = start, loss(start)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
            hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + prior * np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (n * (p - target)) + prior * (w - start))
            while np.abs(step).max() > 1e-9 and loss(w - step) > now:
                step = step / 2
            if np.abs(step).max() <= 1e-9:
                break
            w = w - step
            now = loss(w)
        self.scale, self.offset = map(float, w)
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -50, 50)))

        def least(rows: np.ndarray, share: float) -> float:
            """The highest threshold that catches a share of some positives."""
            rows = rows[np.argsort(p[rows], kind="stable")]
            return p[rows[np.searchsorted(np.cumsum(n[rows]), int((1 - share) * n[rows].sum()), "right")]]

        known = [np.flatnonzero((own == k) & (y == 1)) for k in range(len(CLASSES))]
        self.thresholds = np.array([least(k if len(k) else np.flatnonzero(y == 1), share) for k, share in zip(known, RECALL)])
        told = p >= self.thresholds[own]
        share = lambda of: (n * told)[of].sum() / n[of].sum() if of.any() else np.nan
        self.recall, self.false_rate = (np.array([share((own == k) & (y == label)) for k in range(len(CLASSES))]) for label in (1, 0))


def lengths_of(x: np.ndarray) -> np.ndarray:
    """The class of the length of each window's candidate."""
    return length_class((x[:, BEFORE : BEFORE + INSIDE] > 0).sum(axis=1))


def training_windows(docs: DataFrame) -> DataFrame:
    """label and window of the values of base findings (1) and of checked negatives (0), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, windows = [], []
            for text in texts_of(batch.column(0)):
                base = base_spans(text)
                for cut, start, end in labelled_values(text, base):
                    for a, b in trained_pieces(start, end):
                        labels.append(1)
                        windows.append(window(text, a, b, cut if a == start else None).tobytes())
                for start, end in candidates(text, base):
                    for a, b in trained_pieces(start, end) if is_checked_negative(text[start:end]) else ():
                        labels.append(0)
                        windows.append(window(text, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(windows, pa.binary())], ["label", "window"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "label int, window binary")


def is_kept(x: np.ndarray, seed: int) -> np.ndarray:
    """The third of some windows that calibrates."""
    return np.random.default_rng(seed).random(len(x)) < 1 / 3


@functools.cache
def _started() -> tuple[CharNetwork, np.ndarray, np.ndarray]:
    """The starting set, and a network that was trained on two thirds of it."""
    x, y = starting_set()
    network, train = CharNetwork(), ~is_kept(x, 7)
    network.fit(x[train], y[train])
    return network, x, y


def _windows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WINDOW)


def fit_network(docs: DataFrame) -> CharNetwork:
    """The starting set's network, trained further on it and on all windows out of docs.

    Two thirds of the distinct windows train, dealt by hash to groups of about SHARE; each group trains a copy of
    the network on its windows and the starting set, and the mean of the copies' weights, by windows, is kept.
    The last third calibrates by counts of its logits. Only the weights and the counts, both of fixed size, reach the driver.
    """
    found = written(training_windows(docs).distinct().withColumn("fold", F.pmod(F.xxhash64("window", F.lit(8)), F.lit(3))), "windows")
    started, x, y = _started()
    network, kept = copy.deepcopy(started), is_kept(x, 7)
    fitted = found.filter("fold > 0")
    if groups := -(-fitted.count() // SHARE):
        shared = docs.sparkSession.sparkContext.broadcast((started, x[~kept], y[~kept]))  # of fixed size

        def train(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("window", "ascending"), ("label", "ascending")])
            own, x, y = copy.deepcopy(shared.value[0]), *shared.value[1:]
            own.fit(np.concatenate([x, _windows(rows["window"])]), np.concatenate([y, rows["label"].to_numpy()]), 9, MORE_STEPS, 0.005, whole=True)
            flat = own.weights
            whole = np.round(flat.astype(float) * WEIGHT).astype(np.int64) * len(rows)
            return pa.table({"place": pa.array(range(len(flat)), pa.int32()), "total": whole, "n": pa.array([len(rows)] * len(flat), pa.int64())})

        dealt = fitted.select("label", "window", F.pmod(F.xxhash64("window", F.lit(9)), F.lit(groups)).alias("group")).repartition(groups, "group")
        sums = dealt.groupBy("group").applyInArrow(train, "place int, total long, n long").groupBy("place").agg((F.sum("total") / F.sum("n") / WEIGHT).alias("w"))
        network.weights = np.array([r["w"] for r in sums.orderBy("place").collect()], np.float32)
    read = docs.sparkSession.sparkContext.broadcast(network)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _windows(batch.column(1))
            steps = np.floor(np.clip(read.value.logits(x), -LIMIT, LIMIT) * FINE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths_of(x), pa.int32()), pa.array(steps)], ["label", "own", "step"])

    counts = found.filter("fold = 0").select("label", "window").mapInArrow(tell, "label int, own int, step int").groupBy("label", "own", "step").count()
    more = np.array([tuple(r) for r in counts.orderBy("label", "own", "step").collect()], np.int64).reshape(-1, 4)
    network.calibrate_on(
        np.concatenate([network.logits(x[kept]).astype(float), more[:, 2] / FINE]), np.concatenate([y[kept], more[:, 0]]),
        np.concatenate([lengths_of(x[kept]), more[:, 1]]), np.concatenate([np.ones(kept.sum(), np.int64), more[:, 3]]),
    )
    return network


def find_all(texts: list[str], network: CharNetwork) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, in order."""
    spans = [base_spans(x) for x in texts]
    runs = [(i, a, b) for i, x in enumerate(texts) for a, b in candidates(x, spans[i])]
    places = ((k, i, a, b) for k, (i, start, end) in enumerate(runs) for a, b in pieces(start, end))
    secret, classes = np.zeros(len(runs), bool), length_class(np.array([b - a for _, a, b in runs], np.int64))
    while part := list(itertools.islice(places, 4096)):
        p = network.probabilities(np.stack([window(texts[i], a, b) for _, i, a, b in part]))
        runs_of = np.array([k for k, *_ in part])
        secret[runs_of[p >= network.thresholds[classes[runs_of]]]] = True
    for k in np.flatnonzero(secret).tolist():
        i, a, b = runs[k]
        spans[i].append((a, 3, b))
    return [sorted(s) for s in spans]


def grouped_texts(column: pa.Array, rows: int = 512) -> Iterator[list[str]]:
    texts = texts_of(column)
    while group := list(itertools.islice(texts, rows)):
        yield group


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: CharNetwork) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for texts in grouped_texts(batch.column(1)) for s in find_all(texts, shared.value)]
            counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(3)]
            hashes = [hashlib.sha256(_told([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array([_told(s) for s in found], pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by mask."""
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, network: CharNetwork, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced; n_chars, where there is one, follows. Texts without spans stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = find_all([x or "" for x in texts], shared.value)
            texts = [masked(x, s, mask) if s else x for x, s in zip(texts, found)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if "n_chars" in docs_columns:
                n = docs_columns.index("n_chars")
                counts = [len(x) if s else c for x, s, c in zip(texts, found, columns[n].to_pylist())]
                columns[n] = pa.array(counts, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)

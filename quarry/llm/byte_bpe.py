"""Byte-level BPE without regular expressions: array pre-tokenisation, cached pair merging, decoding.

Code points become classes by table look-up. What a contraction may follow depends on the text before
it, so a five-state automaton runs over the classes: every symbol is a function on states, the closure
of these functions under composition is a small monoid with a multiplication table, and a blocked scan
over monoid elements gives the state before every character at once. Token boundaries then follow from
neighbouring classes and states alone.

Defined cases: a null text counts as empty and has no ids; ids of repeated rows and ties are those of
each row by itself; an empty table gives no rows; a very long text is one unit of work, be it one word (its merges
take a heap, n log n); other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_of, worker_state

#: Classes of characters. LEAD is a space that leads the next word; Q1 and Q2 are apostrophes before one or two letters of a contraction.
LETTER, NUMBER, SPACE, OTHER, END, LEAD, Q1, Q2 = range(8)
#: Fixed values of the pre-tokeniser's pattern: its contractions and Unicode's white space.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: States: nothing open, in other signs or behind a leading space, one or two letters of a contraction to come, contraction ended.
IDLE, SIGNS, ONE_MORE, TWO_MORE, ENDED = range(5)
#: Characters that go through the arrays at once.
SCAN_CHARS = 1 << 20
BLOCK = 512
KEPT_SLICES = 600_000


@cache
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def _transitions() -> np.ndarray:
    """[symbol, state] -> state."""
    t = np.full((8, 5), IDLE, np.uint8)
    t[[OTHER, LEAD]] = SIGNS
    t[Q1], t[Q2] = ONE_MORE, TWO_MORE
    t[[Q1, Q2], SIGNS] = SIGNS
    t[:, ONE_MORE], t[:, TWO_MORE] = ENDED, ONE_MORE
    return t


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(elements as [n, state], product table [first, then], element of each symbol, transitions). Element 0 is the identity."""
    t = _transitions()
    found = {tuple(range(5)): 0}
    queue = [tuple(range(5))]
    for f in queue:
        for s in range(8):
            g = tuple(int(t[s, x]) for x in f)
            if g not in found:
                found[g] = len(found)
                queue.append(g)
    elements = np.array(queue, np.uint8)
    product = np.array([[found[tuple(b[a].tolist())] for b in elements] for a in elements], np.uint16)
    return elements, product, np.array([found[tuple(t[s].tolist())] for s in range(8)], np.uint16), t


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol."""
    elements, product, of_symbol, t = monoid()
    n, blocks = len(symbols), -(-len(symbols) // BLOCK)
    grid = np.full(blocks * BLOCK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.zeros(blocks, np.uint16)  # each block's symbols composed, all blocks side by side
    for row in grid:
        whole = product[whole, of_symbol[row]]
    step = 1
    while step < blocks:  # composed with all before: each round doubles the reach
        whole[step:] = product[whole[:-step], whole[step:]]
        step *= 2
    state = np.concatenate([[IDLE], elements[whole[:-1], IDLE]]).astype(np.uint8)
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        out[j] = state
        state = t[row, state]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens begin, as a mask. ends: the places of the separators behind each text."""
    symbols = class_table()[points]
    symbols[ends] = END
    after = np.append(symbols[1:], END).astype(np.uint8)
    space = symbols == SPACE
    last = space & (after != SPACE) & (after != END)  # of a run that a token follows
    follow = np.append(points[1:], 0)
    for i in np.flatnonzero((points == 0x27) & (symbols == OTHER) & (after == LETTER)).tolist():
        one, two = chr(follow[i]), "".join(map(chr, follow[i : i + 2]))
        if one in ONE_LETTER:
            symbols[i] = Q1
        elif two in TWO_LETTERS:
            symbols[i] = Q2
    symbols[last & (points == 0x20)] = LEAD
    state = states_before(symbols)
    group = np.array([LETTER, NUMBER, SPACE, OTHER, END, SPACE, OTHER, OTHER], np.uint8)[symbols]
    start = np.ones(len(points), bool)
    start[1:] = (group[1:] != group[:-1]) & (symbols[:-1] != LEAD) | last[1:]
    start[1:] &= ~((state[1:] == ONE_MORE) | (state[1:] == TWO_MORE))
    start |= state == ENDED
    start[ends] = True
    start[ends[ends + 1 < len(points)] + 1] = True
    return start


class ByteBpe(dict):
    """slice of text -> its ids as little-endian unsigned 32-bit integers; decodes by a flat table of bytes."""

    def __init__(self, ranks_file: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        names = sorted(self.ranks, key=self.ranks.get)
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.length[[self.ranks[x] for x in names]] = [len(x) for x in names]
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def merged(self, word: bytes) -> list[int]:
        """Ids after merging, again and again, the leftmost pair of lowest rank.

        A part begins at its first byte and ends[first] is where it ends (0 where it was merged away); a heap
        holds the pairs that have a rank, and one whose parts have changed since is passed over.
        """
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        ends = list(range(1, n + 1))
        before = list(range(-1, n))
        pairs = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(pairs)
        while pairs:
            _, first, middle, end = heappop(pairs)
            if ends[first] != middle or ends[middle] != end:
                continue
            ends[first], ends[middle] = end, 0
            if end < n:
                before[end] = first
                if (r := ranks.get(word[first : ends[end]])) is not None:
                    heappush(pairs, (r, first, end, ends[end]))
            if (left := before[first]) >= 0 and (r := ranks.get(word[left:end])) is not None:
                heappush(pairs, (r, left, first, end))
        found, at = [], 0
        while at < n:
            found.append(ranks[word[at : ends[at]]])
            at = ends[at]
        return found

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_SLICES:
            self.clear()
        found = np.asarray(self.merged(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 200:
            self[piece] = found
        return found

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > SCAN_CHARS:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        starts = np.flatnonzero(boundaries(points, ends))
        cut = np.searchsorted(starts, ends)  # each separator is a token of its own
        places = starts.tolist()
        first = 0
        for last in cut.tolist():
            yield b"".join([self[joined[a:b]] for a, b in zip(places[first:last], places[first + 1 : last + 1])])
            first = last + 1

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded text, and the text's length."""
        return np.append(0, np.cumsum(self.length[ids]))

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        at = self.offsets(ids)
        return self.flat[np.arange(at[-1]) + np.repeat(self.begin[ids] - at[:-1], length)].tobytes()


def _worker(ranks_file: bytes) -> ByteBpe:
    return worker_state(hash(ranks_file), lambda: ByteBpe(ranks_file))


def _mapped(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, columns: dict[str, pa.DataType], row, schema: str) -> DataFrame:
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(ranks_file)
        for batch in batches:
            rows = [row(bpe, np.frombuffer(x, "<u4")) for x in bpe.encode_all(texts_of(batch.column(1)))]
            own = list(zip(*rows)) or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(own, columns.values()))], ["doc_id", *columns])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<long>: where each id's bytes begin, and the length in bytes."""
    return _mapped(docs, ranks_path, id_col, text_col, {"ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int64())}, lambda bpe, ids: (ids.astype("<i4"), bpe.offsets(ids)), "ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data binary: the bytes behind ids."""
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(ranks_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode and decode every text; the number of ids and SHA-256 of the ids and of the decoded bytes."""

    def row(bpe: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(docs, ranks_path, "doc_id", "text", columns, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")

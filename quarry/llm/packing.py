"""Packing documents into sequences: cutting-stock column generation over a histogram of lengths.

Texts are encoded and cut into pieces of the sequence's size and a rest. The histogram of rests, by
classes of GRAIN tokens, has a fixed number of bins, so the driver solves one small linear program:
columns are patterns (how many pieces of each class share a sequence), an unbounded-knapsack dynamic
program prices new ones, and the solution is rounded. Ranks of pieces within their class, from counts
per class and salt, then say which sequence and slot each piece gets; nothing but the histogram reaches
the driver, and no class, however common, is ranked in one task.

Defined cases: a null or empty text is the end id alone; rows with a null doc_id are packed like any
other; repeated rows are packed once each; pieces that tie in length rank by doc_id, start and checksum; very
long texts are cut into as many pieces as they need; an empty table gives no pieces; other columns do not
matter. The string of a special token in a text becomes its id, as with the library's default, or with
special_as_text is text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_of, texts_of, written
from .wordpieces import piece_ids

#: Tokens per class of lengths: rounding up costs half of it per piece on average.
GRAIN = 8
#: The linear program stops when its value is within this share of its lower bound.
GAP = 1e-3
MAX_ROUNDS = 20_000


def cut_pieces(docs: DataFrame, vocabulary_path: str, size: int, end_id: int, special_as_text: bool = False) -> DataFrame:
    """A row per piece of at most size ids: doc_id, start, length, ids_crc32, doc_tokens, salt."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(vocabulary, True, special_as_text)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts_of(batch.column(1)))):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, size):
                    part = ids[4 * at : 4 * (at + size)]
                    crc = zlib.crc32(part)
                    rows.append((doc, at, len(part) // 4, crc, total, crc ^ (at * 2654435761 + (doc or 0) * 40503)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, ", ".join(f"{x} long" for x in names))


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern; prices[c - 1] is that of a piece of c units."""
    value, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = prices[:room] + value[room - 1 :: -1][:room]  # a piece of c units leaves room - c
        best = int(options.argmax())
        if options[best] > value[room - 1]:
            value[room], chosen[room] = options[best], best + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(capacity, np.int64), capacity
    while room > 0:
        if chosen[room]:
            pattern[chosen[room] - 1] += 1
            room -= chosen[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def fractional_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Column generation by the revised simplex method: patterns and how often each is used."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m = len(classes)
    columns = np.diag(capacity // (classes + 1)).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    used = inverse @ demand[classes]
    for _ in range(MAX_ROUNDS):
        prices = np.zeros(capacity)
        dual = inverse.sum(axis=0)
        prices[classes] = np.maximum(dual, 0)
        value, pattern = best_pattern(prices, capacity)
        if value <= 1 + GAP:
            break
        column = pattern[classes].astype(float)
        if column @ dual <= 1 + 1e-9:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        ratios = np.where(rising, used / np.where(rising, direction, 1), np.inf)
        leaves = int(ratios.argmin())
        step = max(ratios[leaves], 0)
        used = np.maximum(used - step * direction, 0)
        used[leaves] = step
        row = inverse[leaves] / direction[leaves]
        inverse = inverse - np.outer(direction, row)
        inverse[leaves] = row
        columns[:, leaves] = column
    found = []
    for k in range(m):
        pattern = np.zeros(capacity, np.int64)
        pattern[classes] = columns[:, k].round().astype(np.int64)
        found.append((pattern, float(used[k])))
    return found


def whole_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of sequences that hold every piece: rounded down, the rest by best fit, largest first."""
    left = demand.astype(np.int64).copy()
    result = []
    for pattern, often in sorted(fractional_patterns(left, capacity), key=lambda x: -x[1]):
        need = pattern > 0
        times = int(min(np.floor(often + 1e-7), (left[need] // pattern[need]).min())) if need.any() else 0
        if times > 0:
            left -= times * pattern
            result.append((pattern, times))
    rest: dict[bytes, int] = {}
    while left.any():
        pattern, room = np.zeros(capacity, np.int64), capacity
        while room > 0 and (fits := np.flatnonzero(left[:room])).size:
            size = int(fits[-1]) + 1
            count = min(int(left[size - 1]), room // size)
            pattern[size - 1] += count
            left[size - 1] -= count
            room -= count * size
        rest[pattern.tobytes()] = rest.get(pattern.tobytes(), 0) + 1
    return result + [(np.frombuffer(k, np.int64), n) for k, n in rest.items()]


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence): which ranks of a class a pattern takes."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern).tolist():
            low = taken.get(c, 0)
            taken[c] = low + times * int(pattern[c])
            rows.append((c + 1, low, taken[c], int(pattern[c]), sequence))
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary_path: str, size: int = 4096, end_id: int = 2, special_as_text: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    salts = max(64, partitions(spark))
    pieces = written(cut_pieces(docs, vocabulary_path, size, end_id, special_as_text).withColumns({"class": F.ceil(F.col("length") / GRAIN).cast("int"), "salt": F.pmod("salt", F.lit(salts)).cast("int")}), "pieces")
    capacity = -(-size // GRAIN)

    counts = pieces.groupBy("class", "salt").count()
    demand = np.zeros(capacity, np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("count")).collect():  # at most size / GRAIN rows
        demand[c - 1] = n
    full = demand[-1]
    demand[-1] = 0
    patterns = whole_patterns(demand, capacity)
    if full:
        patterns.append((np.eye(capacity, dtype=np.int64)[-1], int(full)))
    plan = spark.createDataFrame(slots(patterns), "class int, low long, high long, per long, first long")

    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the plan has a row for each class of each pattern: fixed by size / GRAIN, whatever the input
    placed = ranked.join(F.broadcast(plan), "class").filter("rank >= low and rank < high")
    placed = placed.withColumns({"sequence_id": F.expr("first + (rank - low) div per"), "slot": F.expr("(rank - low) % per")})
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))

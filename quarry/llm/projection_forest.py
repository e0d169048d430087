"""Near-duplicate vectors by a forest of random projections.

Every tree splits the space again and again by random directions. Links are pairs at a small angle, so a
split has a spill zone of fixed width in the space of unit vectors, REACH of the distance that the threshold
allows to each side, and what is in it goes to both sides. The split is the place nearest the middle of a
bounded sample, between its quartiles, where the zone holds at most LITTLE_MORE times the least; where even the
least is more than MOST_SPILL, as inside a dense group of near copies, that direction does not split. A tree is
as deep as the number of vectors of a label asks for, so that leaves stay within a few times LEAF vectors (the
zones' copies come on top), or as large as their group, at every size: where a cell
holds fewer than MIN_SPLIT of the sample, its further splits take the limits that the last cell above it
with as many has along the next directions. Vectors are compared only within leaves and only where
labels and dimensions agree; every pair in a leaf is verified in double precision, and links are united
into components.

Equal vectors of a label are one node with a multiplicity. A leaf of more than BLOCK nodes is compared
block by block, each pair of blocks a task's work of its own. A pair that meets in several leaves counts
in the first one only: nodes carry the leaves they are in. Pairs never become rows: a block yields a
number of links for each node and a spanning forest.

Fitted on at most SAMPLE vectors; every vector is routed. Recall is below 1 in principle; the tests and
the README give the measured figure against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing (no links, own component, kept); a null vec_id has no component and is not
kept; repeated rows are vectors like any other; vectors of different dimension are never linked; pairs at
the threshold itself are links; an empty table gives no rows; very long vectors cost in proportion; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .ngram_join import forest, grouped

TREES = 6
LEAF = 32
BLOCK = 128
REACH = 0.5
MOST_SPILL = 0.25
#: Times what the emptiest zone holds that a zone nearer the middle may hold: without dense groups, splits are near the middle.
LITTLE_MORE = 1.5
SAMPLE = 20_000
MIN_SPLIT = 64
MAX_DEPTH = 40
#: Places between a sample's quartiles that a split may take.
PLACES = 33


class Forest:
    """Per tree, cells in heap order (the root is 1) with the lower and upper limit of their spill zones.

    The splits of a tree's level share one direction. low and high [tree, cell, level] are known for the cells
    that the sample reaches: at their own level and, where a cell's children would hold too little of the
    sample, at all levels below it (elsewhere NaN). Where a direction does not split, both are infinite and all
    goes to the left.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, threshold: float = 0.98, reach: float = REACH, seed: int = 17):
        self.depth, self.trees = depth, trees
        self.width = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
        self.zone = reach * float(np.sqrt(max(0.0, 2 - 2 * threshold)))  # of directions of unit variance
        self.directions = np.random.default_rng(seed).standard_normal((trees, self.width, max(1, depth)))
        cells = 2 << min(depth, max(1, len(sample) // MIN_SPLIT).bit_length() + 2)
        self.low, self.high = np.full((2, trees, cells, max(1, depth)), np.nan)
        for t in range(trees):
            x = sample @ self.directions[t] if len(sample) else np.zeros((1, max(1, depth)))
            level = {1: np.arange(len(x))}
            for at in range(depth):
                below: dict[int, np.ndarray] = {}
                for cell, rows in level.items():
                    last = len(rows) < 2 * MIN_SPLIT or 2 * cell + 1 >= cells
                    for k in range(at, depth if last else at + 1):
                        self.low[t, cell, k], self.high[t, cell, k] = self.split(x[rows, k])
                    if not last:
                        middle = (self.low[t, cell, at] + self.high[t, cell, at]) / 2
                        left = x[rows, at] <= middle
                        below |= {2 * cell + side: part for side, part in enumerate((rows[left], rows[~left])) if len(part)}
                level = below

    def split(self, p: np.ndarray) -> tuple[float, float]:
        """The zone, between the quartiles, nearest the middle of those that hold little more of p than the one that holds least; infinite limits if that holds too much."""
        p = np.sort(p)
        places = p[(np.linspace(0.25, 0.75, PLACES) * (len(p) - 1)).astype(int)]
        held = np.searchsorted(p, places + self.zone, "right") - np.searchsorted(p, places - self.zone, "left")
        if held.min() > MOST_SPILL * len(p):
            return np.inf, np.inf
        few = np.flatnonzero(held <= LITTLE_MORE * held.min() + 0.25 * np.sqrt(len(p)))
        place = places[few[np.argmin(np.abs(few - PLACES // 2))]]
        return place - self.zone, place + self.zone

    def leaves(self, vectors: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and codes of the leaves that they are in at their own depth, ascending; a code names the tree and the cell."""
        x = np.zeros((len(vectors), self.width))
        x[:, : min(self.width, vectors.shape[1])] = vectors[:, : self.width]
        rows, codes = [], []
        for t in range(self.trees):
            projected = x @ self.directions[t]
            row, cell, known = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), np.int64)
            for level in range(self.depth + 1):
                on = depths[row] > level
                rows.append(row[~on])
                codes.append(cell[~on] | (t << 48))
                row, cell, known = row[on], cell[on], known[on]
                if not len(row):
                    break
                own = np.minimum(cell, self.low.shape[1] - 1)
                known = np.where((own == cell) & ~np.isnan(self.low[t, own, level]), cell, known)
                p = projected[row, level]
                left, right = p <= self.high[t, known, level], p >= self.low[t, known, level]
                row, known = np.concatenate([row[left], row[right]]), np.concatenate([known[left], known[right]])
                cell = np.concatenate([2 * cell[left], 2 * cell[right] + 1])
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1 in double precision, safe for very large and very small components."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest code in both rows of two code tables padded with -1."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return np.where(same.any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, reach: float = REACH) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    kept = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else x  # half the bytes to move
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), kept.alias("vector"), F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)).alias("good"))
    nodes = written(rows.filter("good").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vectors")

    sample = nodes.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    width = max((len(r[0]) for r in sample), default=1)
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, : len(r[0])] = r[0]
    # of each label as many halvings as bring it to LEAF vectors
    counts = nodes.groupBy("label").agg(F.count("*").alias("_n"))
    depth = F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / LEAF)))).cast("int")
    counts = written(counts.select("label", depth.alias("depth")), "label-depths")
    deepest = counts.agg(F.max("depth")).first()[0] or 0
    shared = spark.sparkContext.broadcast(Forest(unit(points) if len(points) else points, deepest, trees, threshold, reach))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists, depths = batch.column(1).to_pylist(), np.asarray(batch.column(4))
            rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in {len(v) for v in lists}:
                places = np.array([i for i, v in enumerate(lists) if len(v) == size])
                row, code = own.leaves(unit(np.array([lists[i] for i in places], float)), depths[places])
                rows.append(places[row])
                codes.append(code)
            row, code = np.concatenate(rows), np.concatenate(codes)
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(lists))))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code[np.argsort(row, kind="stable")]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], ["node", "vector", "kind", "weight", "codes"])

    routed = nodes.join(counts, "label").select("node", "vector", F.xxhash64("label", F.size("vector")).alias("kind"), "weight", "depth").mapInArrow(route, f"node long, vector {nodes.schema['vector'].dataType.simpleString()}, kind long, weight long, codes array<long>")
    routed = written(routed, "routed")
    placed = routed.withColumn("leaf", F.explode("codes"))
    sizes = written(routed.select("kind", F.explode("codes").alias("leaf")).groupBy("kind", "leaf").count().filter(F.col("count") > BLOCK), "large-leaves")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = placed.join(sizes, ["kind", "leaf"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), blocks).cast("int"), F.lit(0)))
    # a node meets its own block and every other: the lower block's number comes first
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if table.num_rows < 2:
            return
        node, weight, block = (np.asarray(table.column(c)) for c in ("node", "weight", "block"))
        points = unit(np.array(table.column("vector").to_pylist(), float))
        lists = table.column("codes").to_pylist()
        codes = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for i, c in enumerate(lists):
            codes[i, : len(c)] = c
        leaf, low, high = table.column("leaf")[0].as_py(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        near = points @ points.T >= threshold
        if low != high:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        first = np.concatenate([_first_common(codes[a[i : i + 65536]], codes[b[i : i + 65536]]) == leaf for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[first], b[first]
        if not len(a):
            return
        links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
        linked = np.zeros((len(node), len(node)), bool)
        linked[a, b] = linked[b, a] = True
        root, own = forest(linked)
        some = np.flatnonzero(links)
        yield node[some], node[some], links[some].astype(np.int64)
        yield node[root], node[own], np.zeros(len(own), np.int64)

    found = grouped(placed.select("kind", "leaf", "low", "high", "block", "node", "weight", "vector", "codes"), ["kind", "leaf", "low", "high"], ["block", "node"], compare, ("a", "b", "links"))
    found = written(found, "vector-links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("links = 0").select("a", "b"))
    nodes = nodes.join(links, "node", "left").join(groups, "node", "left")
    nodes = written(nodes.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-nodes")
    joined = rows.filter("good").join(nodes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Exact Jaccard join of documents on word shingles, by blocked products of incidence matrices.

Two documents link when 100 * |common shingles| >= 80 * |all shingles|; the result is the component
of each document. Texts with equal sets are one node from the start. The steps:

1. One pass takes each text's set (shingles.py): its size, a 64-bit signature and a parity sketch, and
   counts shingles that are common within a task.
2. Linked sets share one of the first n/5 + 1 shingles in any fixed order (prefix filter). Known common
   shingles come last in the order, the commonest of all at its end. Prefix entries go to the task of their
   shingle as packed arrays. Where more than LARGE prefixes turn out to share a shingle that was not known as
   common, all that COMMON prefixes share become known, and prefixes are taken anew.
3. Sets under one shingle are candidates if sizes allow it and the sketches differ in no more bits than
   linked sets could. Where a shingle still holds more than LARGE sets, all of compatible size are candidates.
   Components of candidates bound what is compared next.
4. Within each candidate component the sparse document by shingle incidence matrix is multiplied by its
   transpose, in blocks of documents: columns (shingles) with the same documents are one column with a
   weight, and each column adds its weight to the pairs of its own documents only. Overlap counts below the
   bound that the two sizes set are dropped. A component of more than BLOCK sets is dealt into random
   blocks, several times over; what then is not in its main part is compared with all sets of that
   component whose size allows a link, again in blocks, of which no more are dealt out at once than about two
   copies of those sets. So every pair that could link is either known to be connected or compared, and no
   pair is ever written out.

The order, the sketches and the blocks only save work; every link is found, none is guessed.

Defined cases: a null text, or one without words, has no shingles and links with nothing, itself its
component; a null doc_id stays out of all links and has a null component; repeated rows are exact copies;
pairs at the threshold itself link; an empty table gives no rows; very long texts are sets like any other;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_written, free_shuffles, partitions, text_of, texts_of, worker_state, written
from .components import components
from .shingles import mixed, shingle_sets

#: A shingle is common from so many sets within one task's stretch of shingles, and so many over all.
LOCAL_COMMON, COMMON = 4, 64
#: Common shingles to know of at most (16 bytes each to every task); the rest only cost time.
COMMON_KNOWN = 1 << 20
STRETCH_SHINGLES = 2 << 20
#: Times that prefixes are taken at most; what then is in too many prefixes only costs time.
ROUNDS = 4
#: Prefix entries that a task packs at once.
PACKED_ENTRIES = 1 << 18
LARGE = 512
BLOCK = 64
DEALS = 2
#: Sizes of sets fall in bands; linked sets (a ratio of at most 1.25) are in the same or in neighbouring ones.
BAND = 1.26


def signature(s: np.ndarray) -> int:
    """Of a set of shingles; 0 only for the empty set."""
    if not len(s):
        return 0
    return int(mixed(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)[None]).view(np.int64)[0]) or 1


def sketch(s: np.ndarray) -> bytes:
    """A bit for each cell that an odd number of shingles falls in; a power of 2 of cells, 2 to 4 times as many as shingles."""
    cells = max(64, 2 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def profiles(docs: DataFrame) -> DataFrame:
    """Rows of texts (common false: doc_id, signature, n, sketch) and of shingles common in a task (signature, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        names = ["common", "doc_id", "signature", "n", "sketch"]
        seen: set[int] = set()
        held, size = [], 0

        def common() -> pa.RecordBatch:
            sort = np.concatenate(held)
            held.clear()
            sort.sort()
            begins, counts = _runs(sort)
            keep = counts >= LOCAL_COMMON
            values, k = sort[begins], int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.array([True] * k, pa.bool_()), pa.nulls(k, pa.int64()), pa.array(values[keep].view(np.int64)), pa.array(counts[keep]), pa.nulls(k, pa.binary())], names)

        for batch in batches:
            signatures, counts, sketches = [], [], []
            for s in shingle_sets(texts_of(batch.column(1))):
                signatures.append(own := signature(s))
                counts.append(len(s))
                sketches.append(sketch(s))
                if own not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(own)
                    held.append(s)
                    size += len(s)
                    if size >= STRETCH_SHINGLES:
                        yield common()
                        size = 0
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(counts), pa.bool_()), batch.column(0), pa.array(signatures, pa.int64()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())], names)
        if held:
            yield common()

    return docs.mapInArrow(run, "common boolean, doc_id long, signature long, n long, sketch binary")


def in_order(s: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles in the order of the prefix filter: those not known as common, then known ones from the rarest on; ties by value."""
    if not len(known):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    last = known[at] == s
    often = s[last]
    return np.concatenate([s[~last], often[np.argsort(counts[at[last]], kind="stable")]])


def prefix_entries(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """bucket, data: entries (shingle, signature, size) of the prefixes of the texts' sets. common: values, ascending, and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_KNOWN values

    def packed(shingles: list, signatures: list, sizes: list) -> pa.RecordBatch:
        lengths = [len(x) for x in shingles]
        entries = np.empty((sum(lengths), 3), np.uint64)
        entries[:, 0] = np.concatenate(shingles)
        entries[:, 1] = np.repeat(np.array(signatures, np.int64).view(np.uint64), lengths)
        entries[:, 2] = np.repeat(np.array(sizes, np.uint64), lengths)
        bucket = (entries[:, 0] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        data = [x[:, :2].tobytes() + x[:, 2].astype("<u4").tobytes() for x in np.split(entries, begins[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(data, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        known = shared.value
        seen: set[int] = set()
        shingles, signatures, sizes, total = [], [], [], 0
        for batch in batches:
            for s in shingle_sets(texts_of(batch.column(1))):
                own = signature(s)
                if not len(s) or own in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(own)
                length = len(s) // 5 + 1
                s = in_order(s, *known)
                shingles.append(s[:length])
                signatures.append(own)
                sizes.append(len(s))
                total += length
                if total >= PACKED_ENTRIES:
                    yield packed(shingles, signatures, sizes)
                    shingles, signatures, sizes, total = [], [], [], 0
        if shingles:
            yield packed(shingles, signatures, sizes)

    return docs.mapInArrow(run, "bucket int, data binary")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(values)))


def postings(entries: DataFrame) -> DataFrame:
    """Rows (posting, a, b): members a of a posting of at most LARGE sets; with posting null a pair of candidates; with a null a shingle that b prefixes share, COMMON or more. Buckets come one after the other and are all that a task holds."""

    def bucket(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = [len(data) // 20 for data in held]
        key = np.concatenate([np.frombuffer(data, "<u8", 2 * n).reshape(n, 2) for data, n in zip(held, counts)])
        size = np.concatenate([np.frombuffer(data, "<u4", n, 16 * n) for data, n in zip(held, counts)])
        order = np.lexsort((key[:, 1], size, key[:, 0]))
        key, size = key[order], size[order]
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1))  # one of equal sets
        key, size = key[new], size[new].astype(np.int64)
        names = ["posting", "a", "b"]
        begins, lengths = _runs(key[:, 0])
        often = lengths >= COMMON
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[begins[often], 0].view(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.array(lengths[often])], names)
        # a shingle's sets by size; where none before is large enough for a link, another posting begins
        apart = (key[1:, 0] != key[:-1, 0]) | (5 * size[:-1] < 4 * size[1:])
        begins, lengths = _runs(np.cumsum(np.append(True, apart)))
        member = key[:, 1].view(np.int64)
        small = (lengths > 1) & (lengths <= LARGE)
        if small.any():
            mark = np.repeat(small, lengths)
            own, length = member[mark], lengths[small]
            at = np.cumsum(length) - length
            name = mixed(np.add.reduceat(mixed(own.view(np.uint64)), at))
            _, first = np.unique(name, return_index=True)  # many shingles have the same members
            keep = np.zeros(len(length), bool)
            keep[first] = True
            rows = np.repeat(keep, length)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, length)[rows].view(np.int64)), pa.array(own[rows]), pa.nulls(int(rows.sum()), pa.int64())], names)
        for begin, length in zip(begins[lengths > LARGE].tolist(), lengths[lengths > LARGE].tolist()):
            head, tail = member[begin], member[begin + 1 : begin + length]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(tail), pa.int64()), pa.array(np.full(len(tail), head)), pa.array(tail)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and name != last:
                    yield from bucket(held)
                    held = []
                held.append(data)
                last = name
        if held:
            yield from bucket(held)

    return entries.sortWithinPartitions("bucket").mapInArrow(run, "posting long, a long, b long")


def counted(rows: DataFrame, value: str, n: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with the highest counts, COMMON_KNOWN at most: values, ascending, and counts."""
    top = rows.select(F.col(value).alias("value"), F.col(n).alias("n")).orderBy(F.desc("n"), "value").limit(COMMON_KNOWN).toArrow()
    values, counts = (np.asarray(top.column(c).combine_chunks(), np.int64) for c in ("value", "n"))
    order = np.argsort(values.view(np.uint64))
    return values[order].view(np.uint64), counts[order]


def also_known(known: tuple[np.ndarray, np.ndarray], shared: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """known with the shingles that COMMON prefixes share; None where all that more than LARGE share were known."""
    if np.isin(shared[0][shared[1] > LARGE], known[0]).all():
        return None
    values, place = np.unique(np.concatenate([known[0], shared[0]]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.maximum.at(counts, place, np.concatenate([known[1], shared[1]]))
    keep = np.sort(np.argsort(-counts, kind="stable")[:COMMON_KNOWN])
    return values[keep], counts[keep]


def grouped(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], Iterator[tuple[np.ndarray, ...]]], names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """work on each group of rows with equal keys, one after the other: a shuffle, a sort and one pass over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for columns in work(table):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [np.asarray(table.column(k)) for k in keys]
            change = np.zeros(table.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in columns)
            change[0] = last is not None and first != last
            last = tuple(c[-1] for c in columns)
            at = 0
            for cut in [*np.flatnonzero(change).tolist(), table.num_rows]:
                if cut < table.num_rows or cut == at:
                    held.append(table.slice(at, cut - at))
                    yield from done(pa.concat_tables(held))
                    held = []
                else:
                    held.append(table.slice(at, cut - at))
                at = cut
        if held:
            yield from done(pa.concat_tables(held))

    spark = rows.sparkSession
    return rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix, as places."""
    root = np.arange(len(linked))
    while True:
        lowest = np.where(linked, root, len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, lowest)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(root)))
    return root[own], own


def similar_sketches(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates among one posting's sets: sizes and sketches allow a link."""
    node, n = np.asarray(table.column("signature")), np.asarray(table.column("n"))
    if len(node) < 2:
        return
    bits = [np.frombuffer(x, "<u8") for x in table.column("sketch").to_pylist()]
    width = np.array([len(x) for x in bits])
    linked = np.eye(len(node), dtype=bool)
    for words in np.unique(width).tolist():  # sets of compatible size have sketches of one width or the next
        own, other = np.flatnonzero(width == words), np.flatnonzero((width == words) | (width == 2 * words))
        folded = np.stack([np.bitwise_xor.reduce(bits[i].reshape(-1, words), axis=0) for i in other.tolist()])
        mine = folded[np.searchsorted(other, own)]
        step = max(1, (4 << 20) // (len(other) * words))
        for i in range(0, len(own), step):
            left = own[i : i + step]
            x, y = n[left][:, None], n[other][None, :]
            differ = np.bitwise_count(mine[i : i + step, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
            close = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (9 * differ <= x + y)
            linked[left[:, None], other[None, :]] |= close
    linked |= linked.T
    a, b = forest(linked)
    if len(a):
        yield node[a], node[b]


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Overlap counts: the sparse incidence matrix of left by the transpose of that of right (or of left).

    A column that most documents have is kept as those that lack it: with a and b for lacking it, it adds
    its weight times (1 - a)(1 - b) to a pair, so it costs as little as one that few have.
    """
    sets = left + (right or [])
    k, cut = len(sets), len(left)
    owner = np.repeat(np.arange(k), [len(x) for x in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins, degree = _runs(values)
    # columns of the same documents are one with a weight: their documents' hashes add up alike
    name = np.add.reduceat(mixed(owner.astype(np.uint64) + np.uint64(1)), begins) if len(begins) else values
    shared = np.flatnonzero(degree > 1)
    _, first, weight = np.unique(name[shared], return_index=True, return_counts=True)
    column = shared[first]
    first_right = 0 if right is None else cut
    rows, columns = slice(0, cut), slice(first_right, k)
    total = np.zeros((k, k))
    for d in np.unique(degree[column]).tolist():  # columns of d documents each
        own = np.flatnonzero(degree[column] == d)
        for part in np.array_split(own, max(1, len(own) * min(d, k - d) ** 2 >> 20)):
            docs, w = owner[begins[column[part], None] + np.arange(d)], weight[part]
            if 2 * d > k:
                lacks = np.ones((len(part), k), bool)
                lacks[np.arange(len(part))[:, None], docs] = False
                docs = np.nonzero(lacks)[1].reshape(len(part), k - d)
                without = np.bincount(docs.ravel(), np.repeat(w, k - d), k)
                total += w.sum() - without[:, None] - without[None, :]
            e = docs.shape[1]
            pairs = (docs[:, :, None] * k + docs[:, None, :]).reshape(len(part), -1)
            total += np.bincount(pairs.ravel(), np.repeat(w, e * e), k * k).reshape(k, k)
    return total[rows, columns]


def links_within(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one block of texts."""
    node = np.asarray(table.column("node"))
    if len(node) < 2:
        return
    sets = list(shingle_sets(table.column("text").to_pylist()))
    n = np.array([len(x) for x in sets])
    linked = (9 * overlaps(sets) >= 4 * (n[:, None] + n[None, :])) & (n[:, None] > 0) & (n[None, :] > 0)
    a, b = forest(linked)
    if len(a):
        yield node[a], node[b]


def links_between(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links from a block of stray texts to a block of others."""
    node, stray = np.asarray(table.column("node")), np.asarray(table.column("stray"))
    if not stray.any() or stray.all():
        return
    sets = list(shingle_sets(table.column("text").to_pylist()))
    n = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
    found = 9 * overlaps([sets[i] for i in left], [sets[i] for i in right]) >= 4 * (n[left][:, None] + n[right][None, :])
    linked = np.zeros((len(node), len(node)), bool)
    linked[np.ix_(left, right)] = found
    linked |= linked.T
    a, b = forest(linked)
    if len(a):
        yield node[a], node[b]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    profile = written(profiles(texts), "profiles")
    own = profile.filter("not common").select("doc_id", "signature", "n", "sketch")
    nodes = written(own.filter("n > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    known = counted(profile.filter("common").groupBy("signature").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON), "signature", "n")

    parts = partitions(spark)
    for left in reversed(range(ROUNDS)):
        entries = prefix_entries(texts, known, 8 * parts).repartition(parts, "bucket")
        found = written(postings(entries), "postings")
        more = also_known(known, counted(found.filter("a is null"), "posting", "b")) if left else None
        if more is None:
            break
        known = more
        delete_written(found)
        free_shuffles(spark)
    members = found.filter("posting is not null and a is not null").select("posting", F.col("a").alias("signature")).distinct().join(nodes, "signature")
    near = grouped(members, ["posting"], ["n", "signature"], similar_sketches)
    candidates = components(near.union(found.filter("posting is null").select("a", "b")))

    free_shuffles(spark)

    part = candidates.select(F.col("node").alias("signature"), F.col("component").alias("part")).join(nodes.select("signature", "node", "n"), "signature").select("part", "node", F.floor(F.log(F.col("n")) / float(np.log(BAND))).cast("int").alias("band"))
    part = written(part, "parts")
    large = written(part.groupBy("part").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), "large")
    part = part.join(large, "part", "left")
    compared = written(part.join(texts, part["node"] == texts["doc_id"]).select("part", "size", "band", "node", "text"), "compared")
    if compared.groupBy("node").count().filter("count > 1").limit(1).count():
        compared = written(compared.dropDuplicates(["node", "text"]), "compared")
    free_shuffles(spark)

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = compared.withColumn("deal", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEALS - 1)))))
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("node", "deal"), blocks), F.lit(0)).cast("int"))
    links = written(grouped(dealt.select("part", "deal", "block", "node", "text"), ["part", "deal", "block"], ["node"], links_within), "links")
    free_shuffles(spark)

    if large.limit(1).count():
        for dealt in _strays(compared, components(links)):
            links = links.union(written(grouped(dealt, ["part", "near", "row", "column"], ["stray", "node"], links_between), "links"))
            free_shuffles(spark)

    linked = components(links)
    final = nodes.select("signature", "node").join(linked, "node", "left").select("signature", F.coalesce("component", "node").alias("component_id"))
    final = written(final, "final")
    return own.join(final, "signature", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"))


def _strays(compared: DataFrame, labels: DataFrame) -> Iterator[DataFrame]:
    """What is still to compare in large parts: blocks of sets outside the part's main component by blocks of all its sets in the same or a neighbouring band of sizes (near is the stray's).

    Each text goes to as many blocks as the other side has. So that this takes no more than about two copies of the parts'
    texts at once, the columns of blocks are dealt out one share after the other.
    """
    placed = compared.filter("size is not null").select("part", "node", "band").distinct().join(labels, "node", "left").select("part", "node", "band", F.coalesce("component", "node").alias("label"))
    placed = written(placed, "placed")
    counts = placed.groupBy("part", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("all > most")
    marked = written(placed.join(written(main, "main").select("part", "main"), "part"), "marked")
    around = marked.withColumn("near", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
    sizes = around.groupBy("part", "near").agg(F.count_if((F.col("label") != F.col("main")) & (F.col("near") == F.col("band"))).alias("strays"), F.count("*").alias("others")).filter("strays > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = written(sizes.select("part", "near", "strays", "others", blocks("strays").alias("rows"), blocks("others").alias("columns")), "stray-blocks")
    copies, others = sizes.agg(F.sum(F.col("strays") * F.col("columns") + F.col("others") * F.col("rows")), F.sum("others")).first()
    shares = -(-copies // (2 * others)) if copies else 0
    deal = F.xxhash64("node")
    sizes = sizes.drop("strays", "others")
    for share in range(shares):
        columns = F.when(F.col("columns") > share, F.sequence(F.lit(share), F.col("columns") - 1, F.lit(shares)))
        stray = marked.filter("label <> main").withColumn("near", F.col("band")).join(sizes, ["part", "near"])
        stray = stray.select("part", "near", F.pmod(deal, F.col("rows")).cast("int").alias("row"), F.explode(columns).alias("column"), "node", F.lit(True).alias("stray"))
        other = around.join(sizes, ["part", "near"]).withColumn("column", F.pmod(deal, F.col("columns")).cast("int")).filter(F.col("column") % shares == share)
        other = other.select("part", "near", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "column", "node", F.lit(False).alias("stray"))
        dealt = written(stray.union(other), "strays")
        yield dealt.join(compared.select("node", "text"), "node")
        delete_written(dealt)

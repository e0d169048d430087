"""The prefix trie of conversations, by partition refinement.

A turn is the SHA-256 of its role and text. Conversations with the same turns throughout are one sequence with a
weight; all sequences are one class, the root. Turn after turn every active class is split by its members' next
turn; each part is a node, named by its smallest conversation. A class of one sequence retires: its tail is a
unary chain. A class with at most LOCAL turns left is split further in a task, with as many others as make up
GROUP turns, all of them turn by turn side by side in numpy; only larger classes go on as Spark rounds, one job's
step per turn, from written tables. So the rounds are as many as the turns over which a class keeps more than LOCAL.
Then the trie is folded back: chains by sums from behind in blocks of CHAIN turns, local classes in their task, the
few larger ones level by level from below.

A node's conversations that end in it are one sequence. Their ids are sorted by ranges, joined there to pieces of
text, and one task reads a sequence's pieces in order through its digest, holding one piece at a time.

Defined cases: null roles and texts are empty; turns of a conversation that share their number are ordered by role
and text, and each counts; rows without conv_id are no conversation; a conversation that is left without turns
ends in the root; negative ids take the sign of the dividend in c % 100; an empty table has no trie and gives no
rows; a very long conversation is a chain that no task holds whole; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.merge import placed

from .common import partitions, text_of, written

#: Of the first turns of its hundred's conversation, one takes crc32(conv_id) % HEADS.
FAMILY, HEADS = 100, 6
#: Turns of a class that a task splits by itself, of all classes of a task about, and of a block of a chain.
LOCAL, GROUP, CHAIN = 1024, 1 << 16, 4096
#: Ids in a piece of an end digest.
PIECE = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean, ender long"


def _heads(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): conv_id, pos (from 1), key, length of every rebuilt turn; and every conv_id."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of().alias("text"))
    place = placed(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"])
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    own = place.select("conv_id", "_place", F.unhex(F.sha2(said, 256)).alias("key"), F.length("text").cast("long").alias("length"))
    convs = own.groupBy("conv_id").agg(F.min("_place").alias("first"), F.count("*").alias("n_own"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "heads": _heads(F.col("conv_id"))})
    convs = written(convs, "conversations")
    n_base = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    each = convs.join(n_base, "base", "left").withColumn("taken", F.least("heads", F.coalesce("n_base", F.lit(0))))
    at = own.join(each.select("conv_id", "first", "heads", "taken"), "conv_id").withColumn("at", F.col("_place") - F.col("first"))
    at = written(at.select("conv_id", "at", "key", "length", "heads", "taken"), "own")
    tails = at.filter(F.col("at") >= F.col("heads")).withColumn("pos", F.col("taken") + F.col("at") - F.col("heads") + 1)
    begins = at.filter(F.col("at") < HEADS - 1).select(F.col("conv_id").alias("base"), "at", "key", "length")
    begins = each.select("conv_id", "base", "heads").join(begins, "base").filter(F.col("at") < F.col("heads")).withColumn("pos", F.col("at") + 1)
    columns = ["conv_id", "pos", "key", "length"]
    turns = tails.select(*columns).unionByName(begins.select(*columns))
    # in the order of pos, so that a round reads its turn's rows only
    turns = written(turns.repartitionByRange(partitions(conversations.sparkSession), "pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "turns")
    return turns, convs.select("conv_id")


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, members): rep (smallest conversation), weight, n (turns); and (rep, conv_id) of those of several."""
    marks = {"x": F.bit_xor(F.xxhash64("pos", "key")), "y": F.bit_xor(F.xxhash64("key", "pos", F.lit("second")))}
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in marks.items()))
    each = written(convs.join(each, "conv_id", "left").fillna(0), "marks")
    same = written(each.groupBy("n", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    return same.select("rep", "weight", "n"), each.join(same.filter("weight > 1"), ["n", "x", "y"]).select("rep", "conv_id")


def digests(members: DataFrame) -> DataFrame:
    """rep, sha: of each sequence of several conversations the SHA-256 of their ids in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                reps, ids = np.asarray(part.column(0)), part.column(1).to_pylist()
                begins = np.append(0, np.flatnonzero(np.diff(reps)) + 1).tolist()
                texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)])]
                yield pa.RecordBatch.from_arrays([pa.array(reps[begins]), pa.array([ids[a] for a in begins], pa.int64()), pa.array(texts, pa.string())], ["rep", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if rep != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = rep, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["rep", "sha"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["rep", "sha"])

    parts = partitions(members.sparkSession)
    ranged = members.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = ranged.mapInArrow(joined, "rep long, first long, ids string")
    return pieces.repartition(parts, "rep").sortWithinPartitions("rep", "first").mapInArrow(digested, "rep long, sha string")


def refine(label: np.ndarray, parent: np.ndarray, depth: np.ndarray, rep: np.ndarray, weight: np.ndarray, pos: np.ndarray, key: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The nodes of some classes and all below them, as the columns of NODE.

    A row for each sequence (rep, weight) of a class (label, its parent, its depth) and each of its turns from
    the class's own on; key: the turn as a number.
    """
    order = np.lexsort((pos, rep, depth, label))
    label, parent, depth, rep, weight, key, length = (x[order] for x in (label, parent, depth, rep, weight, key, length))
    fresh = np.ones(len(rep), bool)
    fresh[1:] = (rep[1:] != rep[:-1]) | (label[1:] != label[:-1]) | (depth[1:] != depth[:-1])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(rep)))
    label, parent, depth, rep, weight = (x[begin] for x in (label, parent, depth, rep, weight))
    first = np.ones(len(begin), bool)
    first[1:] = (label[1:] != label[:-1]) | (depth[1:] != depth[:-1])
    active, group = np.arange(len(begin)), np.cumsum(first) - 1
    above = np.full(int(group.max(initial=-1)) + 1, -1)  # the node of each group, none yet
    out: list[list[np.ndarray]] = []  # conv_id, depth, node above, n_convs, length, ender
    nodes, t = 0, 0
    while active.size:
        both = np.stack([group, key[begin[active] + t]])
        _, at, group, size = np.unique(both, axis=1, return_index=True, return_inverse=True, return_counts=True)
        group = group.reshape(-1)
        low = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(low, group, rep[active])
        total = np.zeros(len(size), np.int64)
        np.add.at(total, group, weight[active])
        ender = np.full(len(size), -1)
        ends = count[active] == t + 1
        ender[group[ends]] = active[ends]
        out.append([low, depth[active[at]] + t, above[both[0, at]], total, length[begin[active[at]] + t], ender])
        here = nodes + np.arange(len(size))
        nodes += len(size)
        # classes of one sequence retire, their tails are chains
        alone = (size[group] == 1) & ~ends
        own = active[alone]
        tail = count[own] - t - 1
        if tail.sum():
            which = np.repeat(np.arange(len(own)), tail)
            step = np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
            ids = nodes + np.arange(len(step))
            up = np.where(step == 0, here[group[alone]][which], ids - 1)
            s = own[which]
            out.append([rep[s], depth[s] + t + 1 + step, up, weight[s], length[begin[s] + t + 1 + step], np.where(step == tail[which] - 1, s, -1)])
            nodes += len(step)
        on = ~ends & ~alone
        above = here
        active, group = active[on], group[on]
        t += 1
    conv, deep, up, n_convs, chars, ender = (np.concatenate(x) for x in zip(*out))
    children, leaves, saved = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), (n_convs - 1) * chars
    levels = np.argsort(-deep, kind="stable")
    for level in np.split(levels, np.flatnonzero(np.diff(deep[levels])) + 1):
        leaves[level] = np.maximum(leaves[level], children[level] == 0)
        low = level[up[level] >= 0]
        np.add.at(children, up[low], 1)
        np.add.at(leaves, up[low], leaves[low])
        np.add.at(saved, up[low], saved[low])
    top = up < 0
    # a class's own node has the parent that it came with
    parents = dict(zip(zip(label.tolist(), depth.tolist()), parent.tolist()))
    up_conv = np.where(top, 0, conv[up])
    up_conv[top] = [parents[x] for x in zip(conv[top].tolist(), deep[top].tolist())]
    return [conv, deep, up_conv, n_convs, children, leaves, saved, top, np.where(ender >= 0, rep[ender], 0), ender < 0]


def local_nodes(rows: DataFrame, groups: int) -> DataFrame:
    """refine() over classes dealt into groups by a hash."""

    def run(table: pa.Table) -> pa.Table:
        key = np.asarray(table.column("key").combine_chunks().dictionary_encode().indices)
        columns = [np.asarray(table.column(c)) for c in ("label", "parent", "depth", "rep", "weight", "pos")]
        *found, ender, none = refine(*columns, key.astype(np.int64), np.asarray(table.column("length")))
        names = [x.split()[0] for x in NODE.split(", ")]
        return pa.Table.from_arrays([*map(pa.array, found), pa.array(ender, mask=none)], names)

    bucket = F.pmod(F.xxhash64("label", "depth"), F.lit(groups))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, NODE)


def chain_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of retired sequences: rep, weight, n, parent, depth, and their turns from depth on."""
    from_behind = Window.partitionBy("rep", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.floor(F.col("pos") / CHAIN))
    shared = rows.filter("weight > 1")
    blocks = shared.groupBy("rep", "block").agg(F.sum("length").alias("sum"))
    later = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("rep", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("later"))
    shared = shared.withColumn("sum", F.sum("length").over(from_behind)).join(blocks, ["rep", "block"])
    shared = shared.withColumn("saved", (F.col("weight") - 1) * (F.col("sum") + F.col("later"))).drop("sum", "later")
    every = shared.unionByName(rows.filter("weight = 1").withColumn("saved", F.lit(0).cast("long")))
    top, last = F.col("pos") == F.col("depth"), F.col("pos") == F.col("n")
    return every.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), top.alias("top"), F.when(last, F.col("rep")).alias("ender"),
    )


def _folded(upper: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, length, ender) with what the nodes below them sum up to."""
    sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    own = (F.col("n_convs") - 1) * F.col("length")
    return upper.join(sums, "conv_id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.lit(True).alias("top"), "ender",
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos from 1 without a gap, key (equal for equal turns), length; convs: every conv_id.
    """
    spark = turns.sparkSession
    same, members = sequences(turns, convs)
    low, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    empty = spark.createDataFrame([], NODE)
    if not n_convs:
        return empty.select(*empty.columns[:7], F.lit("").alias("ends_sha256"))
    n_turns = turns.count()
    level = same.withColumn("label", F.lit(low).cast("long"))
    ender = same.filter("n = 0").first()  # one row at most
    root = spark.createDataFrame([(low, 0, None, n_convs, 0, ender and ender["rep"])], "conv_id long, depth long, parent_conv_id long, n_convs long, length long, ender long")
    uppers, retired, depth = [root], [], 0
    while True:
        depth += 1
        step = level.join(turns.filter(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "key", "length"), "rep")
        left = F.col("n") - depth + 1
        groups = step.groupBy("label", "key").agg(F.min("rep").alias("next"), F.sum("weight").alias("n_convs"), F.count("*").alias("size"), F.sum(left).alias("left"), F.min("length").alias("length"), F.max(F.when(F.col("n") == depth, F.col("rep"))).alias("ender"))
        kind = F.when(F.col("size") == 1, "alone").when(F.col("left") <= LOCAL, "local").otherwise("on")
        groups = written(groups.withColumn("kind", kind), "classes")
        split = step.drop("length").join(groups.select("label", "key", "next", "kind"), ["label", "key"])
        split = written(split.select("rep", "weight", "n", F.col("label").alias("parent"), F.col("next").alias("label"), "kind", F.lit(depth).cast("long").alias("depth")), "members")
        retired.append(split.filter("kind <> 'on'"))
        more = groups.filter("kind = 'on'")
        if more.isEmpty():
            break
        uppers.append(more.select(F.col("next").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("label").alias("parent_conv_id"), "n_convs", "length", "ender"))
        level = split.filter("kind = 'on'").select("rep", "weight", "n", "label")
    rest = reduce(DataFrame.unionByName, retired)
    rest = rest.join(turns.withColumnRenamed("conv_id", "rep"), "rep").filter(F.col("pos") >= F.col("depth"))
    groups = max(partitions(spark), -(-n_turns // GROUP))
    local = local_nodes(rest.filter("kind = 'local'").drop("kind", "n"), groups)
    nodes = written(local.unionByName(chain_nodes(rest.filter("kind = 'alone'").drop("kind", "key", "label"))), "nodes")
    done, above = [nodes], None
    for at in range(len(uppers) - 1, -1, -1):
        below = nodes.filter(F.col("top") & (F.col("depth") == at + 1))
        above = written(_folded(uppers[at], below if above is None else below.unionByName(above)), "folded")
        done.append(above)
    every = reduce(DataFrame.unionByName, done)
    shas = digests(members)
    ended = every.filter(F.col("ender").isNotNull()).join(shas, F.col("ender") == F.col("rep"), "left")
    ended = ended.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.col("ender").cast("string"), 256))).drop("rep", "sha")
    plain = every.filter(F.col("ender").isNull()).withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(plain).drop("top", "ender")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations))

"""Quotation linking: who quotes whom in conversations, and the conversations without quotes, in reply order.

A line's level is the number of > and | before its text (a line with a further | behind its text is a
table's, not a quote). Consecutive lines of one level are a passage. A line such as "On ... wrote:" (also
Le/Am/El ... a écrit/schrieb/escribió) whose next line that is not blank has a higher level names the quote;
it belongs to no passage and goes with the quotes. Quoted passages, and their lines, are normalised (lower
case, white space as single spaces) and hashed, and so are unquoted passages, their paragraphs and lines. A
quoted hash links to the first message that says it unquoted: in the same conversation before the quoting
turn, or else in the first other conversation that says it. A message replies to the latest turn of its own
conversation that it quotes at level 1; a thread's root is found by doubling.

Ordered by thread and turn, every message stands behind the one it replies to: that is its position. The
messages of PART positions of a conversation, without quotes, are put together in that order.

Originals are reduced to one per hash and conversation, and to the first two conversations of a hash,
before the join, so a passage that every conversation shares is one row on that side (SALTS rows, so that
those who quote it are spread).

Defined cases: a null or empty text has no passages and stays; messages with a null conv_id or turn quote
nothing in their conversation, are quoted by none and have no position; repeated rows get the same links
each and a position each; ties in the order follow role and text; very long texts are parsed whole, each in
one task; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.merge import placed

from .common import written

MARKS = re.compile(r"^[ \t]*((?:[>|][ \t]?)+)")
#: Fixed patterns: how mail programs name a quote, in four languages, in lower case.
NAMES_QUOTE = re.compile(r"^[ \t]*(?:on|le|am|el)[ \t].*(?:wrote|a écrit|schrieb|escribió)[^:]*:[ \t\r]*$")
SALTS = 16
#: Positions of a conversation whose texts are put together in one row.
PART = 1000
UNIT = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("whole", pa.bool_())])


def passages(text: str) -> list[tuple[int, list[str]]]:
    """Level and lines of each passage; lines that name a quote are in none."""
    lines: list[tuple[int, str]] = []
    for line in text.split("\n"):
        marks = MARKS.match(line)
        if marks and not ("|" in marks[1] and "|" in line[marks.end() :]):
            lines.append((sum(marks[1].count(c) for c in ">|"), line[marks.end() :]))
        else:
            lines.append((0, line))
    found: list[tuple[int, list[str]]] = []
    following = -1  # level of the next line that is not blank
    for level, line in reversed(lines):
        if following > level and NAMES_QUOTE.match(line.lower()):
            following = level
            found.append((-1, []))  # parts what stands on both sides
            continue
        if line.strip():
            following = level
        if not found or found[-1][0] != level:
            found.append((level, []))
        found[-1][1].append(line)
    return [(level, own[::-1]) for level, own in reversed(found) if level >= 0]


def normalised_hash(text: str) -> int | None:
    """64 bits of the normalised text; None where nothing is left of it."""
    plain = " ".join(text.lower().split())
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8"), digest_size=8).digest(), "little", signed=True) if plain else None


def units(level: int, lines: list[str]) -> set[tuple[int, int, bool]]:
    """(level, hash, whether it is the whole passage) of a passage, its paragraphs and its lines."""
    paragraphs, current = [], []
    for line in [*lines, ""]:
        if line.strip():
            current.append(line)
        elif current:
            paragraphs.append("\n".join(current))
            current = []
    whole = normalised_hash("\n".join(lines))
    parts = {h for x in [*paragraphs, *lines] if (h := normalised_hash(x)) is not None} - {whole}
    return {(level, h, False) for h in parts} | ({(level, whole, True)} if whole is not None else set())


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, max_level, units."""
    names = ["conv_id", "turn", "role", "text", "n_quotes", "max_level", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, quotes, levels, found = [], [], [], []
            for text in batch.column(3).to_pylist():
                parts = passages(text or "")
                quoted = [level for level, lines in parts if level and any(x.strip() for x in lines)]
                # without quotes the text stays as it is
                texts.append("\n".join(x for level, lines in parts if not level for x in lines).strip() if quoted else text)
                quotes.append(len(quoted))
                levels.append(max(quoted, default=0))
                found.append([dict(zip(("level", "hash", "whole"), u)) for u in sorted(set().union(*(units(*p) for p in parts)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(quotes, pa.int32()), pa.array(levels, pa.int32()), pa.array(found, pa.list_(UNIT))], names)

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, n_quotes int, max_level int, units array<struct<level:int,hash:long,whole:boolean>>")


def quotation_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, whole, to_conv, to_turn: each quoted unit and its original."""
    said = rows.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*").filter("conv_id is not null and turn is not null")
    quoted = written(said.filter("level > 0").distinct(), "quoted")
    # only what is quoted at all need be looked for
    asked = said.filter("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    near = written(asked.groupBy("conv_id", "hash").agg(F.min("turn").alias("near")), "originals")
    # the first two conversations, so that one is left where the other is the quoting message's own; each task sends two at most
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).filter("place <= 2")
    original = lambda place: F.min(F.when(F.col("place") == place, F.struct("conv_id", "near")))
    far = written(ranked.groupBy("hash").agg(original(1).alias("first"), original(2).alias("second")), "originals")
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = quoted.join(near, ["conv_id", "hash"], "left").withColumn("salt", salt("conv_id", "turn")).join(far, ["hash", "salt"], "left")
    own = F.col("near") < F.col("turn")
    elsewhere = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    linked = linked.withColumn("to", F.when(own, F.struct("conv_id", "near")).otherwise(elsewhere)).filter("to is not null")
    return linked.select("conv_id", "turn", "level", "hash", "whole", F.col("to.conv_id").alias("to_conv"), F.col("to.near").alias("to_turn"))


def thread_roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth for each reply (conv_id, turn, reply_to), by doubling."""
    now = written(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = written(now.join(up, ["conv_id", "root"], "left"), "threads")
        now = step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not step.filter("next is not null").limit(1).count():
            return now


def link_quotations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, text, n_quotes, max_level, n_linked, reply_to, thread, depth."""
    rows = written(parsed(messages), "messages")
    links = written(quotation_links(rows), "quotations")
    replies = links.filter("to_conv = conv_id").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("to_turn"))).alias("reply_to")).filter("reply_to is not null")
    replies = written(replies, "replies")
    counts = links.groupBy("conv_id", "turn").agg(F.count_distinct(F.when(F.col("whole"), F.struct("level", "hash"))).alias("n_linked"))
    known = written(counts.join(replies, ["conv_id", "turn"], "left").join(thread_roots(replies), ["conv_id", "turn"], "left"), "linked")
    joined = rows.drop("units").join(known, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", "text", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """link_quotations' rows with position, from 0 in each conversation by thread and turn. Places come from ranges of all rows, so that no task holds a conversation."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = placed(linked.filter(known), ["conv_id", "thread", "turn", "role", "text"])
    first = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_place").alias("_first"))
    rows = rows.join(first, F.col("conv_id") == F.col("_conv")).withColumn("position", F.col("_place") - F.col("_first")).drop("_conv", "_first", "_place")
    return rows.unionByName(linked.filter(~known).withColumn("position", F.lit(None).cast("long")))


def conversations(ordered: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, conversation: part positions' messages in reply order, each as "role: text", without quotes."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    groups = ordered.filter("position is not null").groupBy("conv_id", F.expr(f"position div {part}").alias("part"))
    told = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))  # at most part messages
    return groups.agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("conversation"))


def conversations_without_quotes(messages: DataFrame) -> DataFrame:
    """in_reply_order's rows; the first message of every part of a conversation carries the part's text as conversation."""
    ordered = written(in_reply_order(link_quotations(messages)), "ordered")
    told = conversations(ordered).select(F.col("conv_id").alias("_conv"), (F.col("part") * PART).alias("_at"), "conversation")
    return ordered.join(told, (F.col("conv_id") == F.col("_conv")) & (F.col("position") == F.col("_at")), "left").drop("_conv", "_at")

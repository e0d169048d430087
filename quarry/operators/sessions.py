"""Gate sessions over logs of readings, and replay of ledgers.

A session walks a pack without cycles, so it passes each gate at most once. The batch form follows that:
one step per gate of the pack's longest path, whatever the number of events. A step joins the sessions'
places with their readings, takes the latest reading held at arrival or else the first after it,
evaluates it and moves on. The streaming form (quarry.streaming) handles the same events one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.gates import TERMINAL, evaluate, token

from .shared import written

#: A pack's rows are sent to every task up to this many; more are joined by Spark's own choice.
FEW_RULES = 10_000


def few(rules: DataFrame) -> DataFrame:
    """rules with a broadcast hint if they are few."""
    return F.broadcast(rules) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else rules


def walk(sessions: DataFrame, readings: DataFrame, gates: DataFrame, steps: int) -> DataFrame:
    """The ledger: session, step, gate, ord, outcome, target, commit.

    sessions: session, gate (its start). readings: session, gate, ord, num, flag (only those that fit
    their gate). gates: gate, type, op, value, vmin, vmax, next; a gate whose spec does not fit stops the
    session. A step's places are a row per session at most and written before the next step reads them.
    """
    place = sessions.withColumn("arrival", F.lit(0).cast("long"))
    rules = few(gates)
    ledger = None
    for step in range(steps):
        near = place.join(readings, ["session", "gate"])
        held = F.col("ord") <= F.col("arrival")
        best = near.groupBy("session", "gate", "arrival").agg(F.max_by(F.struct("ord", "num", "flag"), F.when(held, F.col("ord"))).alias("held"), F.max(F.when(held, F.col("ord"))).alias("any"), F.min_by(F.struct("ord", "num", "flag"), F.when(~held, F.col("ord"))).alias("later"))
        read = best.select("session", "gate", "arrival", F.when(F.col("any").isNotNull(), F.col("held")).otherwise(F.col("later")).alias("r"))
        done = read.join(rules, "gate").withColumn("outcome", evaluate("type", "op", "r.num", "r.flag", "value", "vmin", "vmax")).filter("outcome is not null")
        done = done.select("session", F.lit(step).alias("step"), "gate", F.greatest("arrival", "r.ord").alias("ord"), "outcome", F.try_element_at("next", F.col("outcome")).alias("target"))
        done = written(done, "step")
        ledger = done if ledger is None else ledger.unionByName(done)
        place = done.filter(~F.col("target").rlike(TERMINAL)).select("session", F.col("target").alias("gate"), F.col("ord").alias("arrival"))
    return ledger.withColumn("commit", token(F.lit("GATE"), "gate", "outcome"))


def replay(commits: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """session, position, sound: where a ledger's gate commits lead, and whether each was for the place the last one led to.

    commits: session, ord, gate, outcome; edges: gate, outcome, target; starts: session, start. A commit's
    gate must equal the target of the commit before it, which a window over the session can tell.
    """
    over = Window.partitionBy("session").orderBy("ord")
    rows = commits.join(few(edges), ["gate", "outcome"], "left").join(starts, "session")
    rows = rows.withColumn("expected", F.coalesce(F.lag("target").over(over), "start"))
    return rows.groupBy("session").agg(F.max_by("target", "ord").alias("position"), F.bool_and(F.coalesce(F.col("gate") == F.col("expected"), F.lit(False)) & F.col("target").isNotNull()).alias("sound"))


def score_readings(readings: DataFrame, gates: DataFrame) -> DataFrame:
    """Each reading with each gate it could belong to, and how well it fits.

    readings: reading, unit, state, words (array), current; gates: gate, type, gate_unit, condition,
    quantity_words (array). Two points for a matching state, one per shared word, half for the current gate.
    """
    if gates.limit(FEW_RULES + 1).count() > FEW_RULES:
        raise ValueError("readings are routed among one pack's gates")
    pairs = readings.join(F.broadcast(gates))
    fits = (F.col("type") != "boolean") & (F.col("unit").isNull() | (F.lower("unit") == F.lower("gate_unit"))) & (F.col("state").isNull() | (F.col("state") == F.col("condition")))
    score = F.when(F.col("state").isNotNull(), 2.0).otherwise(0.0) + F.size(F.array_intersect("words", "quantity_words")) + F.when(F.col("gate") == F.col("current"), 0.5).otherwise(0.0)
    return pairs.withColumn("score", F.when(fits, score).otherwise(-1e9))

"""Conversations about packs as a stream: free text in, events out, with typed state that ends.

A turn is (session, turn, text). What a text says is told by column expressions before any state (said()): readings with
the words around them, codes, yes or no, an acknowledgement, captured codes, a choice, a question, a vehicle, and the
pack that its symptom belongs to. A processor then keeps for each session a value state with its pack, place and
vehicle, map states with readings, outcomes, limits and choices by gate, and list states of codes and of what is proposed;
only states that a turn changes are written.

* A pack is taken at the first turn that names a symptom of it; before that there is nothing to do but to answer.
* What a turn tells is proposed, and the next turn is its yes, its no, or something else, which drops it. A direct yes
  or no to a yes/no gate is its own confirmation.
* A reading goes to the gate not yet passed that it fits best; where two fit equally well, to the current gate
  or to none. While a gate waits for its limits, numbers are these limits.
* A turn gives one row: context, commits, problem, status, gate, and in asks what to look for in the documents.

snippets() finds what all rows ask for in one search. A session ends by silence: a turn whose number is more than
silence above the last one's begins anew, and the state of a session that nobody turns to goes after ttl. newest() keeps
the rows of a number of sessions, the oldest out. Turns of a micro-batch go in order of their number, all of one session
at once; a turn without number, or not above the last, is reported and changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions import extraction
from quarry.functions.text import col
from quarry.operators import packs as pack_rules
from quarry.operators.retrieval import bm25

from .sessions import READING, Session

OUTPUT = "session string, turn long, context string, commits array<string>, problem string, status string, gate string, asks string, width int"
PLACE = "pack string, at string, noted boolean, turn long, make string, model string, year int, known boolean"
#: Facts by gate, each a map state: what a gate's name leads to.
MAPS = {"values": "num double, flag boolean", "passed": "outcome string", "operator": "value double, min double, max double", "chosen": "choice int", "acked": "acked boolean"}
PROPOSED = "kind string, gate string, num double, flag boolean, unit string, state string, low double, high double, text string"
#: Characters of a snippet: of an answer, and of a source of the current step.
ANSWER, SOURCE = 240, 200
WORD = re.compile(r"[a-z0-9]+")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def said(turns: DataFrame, symptoms: dict[str, list[str]]) -> DataFrame:
    """session, turn, text, and what the text says; symptoms: patterns by pack, in order."""
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), text.alias("text"))
    rows = rows.withColumns({"answers": extraction.answers("text"), "readings": extraction.readings("text"), "codes": extraction.trouble_codes("text"), "vehicle": extraction.subject("text")})
    pick = F.regexp_extract("text", r"^\s*#?(\d{1,9})\s*$", 1)
    return pack_rules.route(rows, symptoms).withColumn("pick", F.when(pick != "", pick.cast("int")))


def packed(rows: DataFrame) -> DataFrame:
    """session, turn, and the rest of said() as one JSON text: a worker takes rows apart cell by cell, which costs more than what it does with them."""
    rest = F.struct(*(c for c in rows.columns if c not in ("session", "turn")))
    return rows.select("session", "turn", F.to_json(rest, {"ignoreNullFields": "false"}).alias("told"))


@lru_cache(1024)
def unpacked(told: str) -> dict:
    """What a text says, to be read only: equal texts share it."""
    found = json.loads(told)
    for reading in found["readings"]:
        reading["value"] = float(reading["value"])  # "Infinity" is a string in JSON
    return found


class Talk:
    """One session between turns: its facts, its vehicle, and what it makes of a turn."""

    def __init__(self, packs: dict[str, dict], pack: str | None, facts: dict | None = None, vehicle: tuple | None = None):
        self.packs, self.pack, self.vehicle = packs, pack, vehicle
        self.session = Session(packs[pack], facts, intake=False) if pack else None
        self.turn = facts["turn"] if facts else -1

    def take(self, told: dict) -> tuple:
        """context, commits, problem, asks, width."""
        self.vehicle = self.vehicle or (tuple(told["vehicle"][k] for k in ("make", "model", "year")) if told["vehicle"]["make"] else None)
        if self.session is None and told["pack"]:
            self.pack, self.session = told["pack"], Session(self.packs[told["pack"]], None, intake=False)
        if self.session is None:
            return "INTAKE", [], None, told["text"], ANSWER
        self.session.problems = []
        context, commits = self._heard(told)
        problem = "; ".join(self.session.problems) or None
        if context == "CHAT-Q":
            return context, commits, problem, told["text"], ANSWER
        gate = self.session.gate
        if context != "CHAT-CONFIRM" or self.session.facts["proposed"] is None:
            if self.session.status() == "NEED_READING" and gate:
                return context, commits, problem, " ".join(x for x in (gate.get("title"), gate.get("quantity")) if x), SOURCE
        return context, commits, problem, None, None

    def _step(self, kind: str, **more) -> list[str]:
        """One event of the session's own, at the turn that is being taken."""
        self.session.facts["turn"] -= 1
        commits, problem = self.session.handle({"turn": self.session.facts["turn"] + 1, "kind": kind} | more)
        if problem:
            self.session.problems = [problem]
        return commits

    def _heard(self, told: dict) -> tuple[str, list[str]]:
        session, answers = self.session, told["answers"]
        if session.facts["proposed"] is not None:
            if answers["yes"]:
                return "CHAT-CONFIRM", self._step("yes")
            session.facts["proposed"] = None
            if answers["no"]:
                return "CHAT-CONFIRM", []
        status, gate = session.status(), session.gate
        if status == "NEED_ACK" and answers["ack"]:
            return "TURN", self._step("ack")
        if status == "NEED_DTCS" and answers["codes_captured"]:
            return "TURN", self._step("codes_captured")
        if status == "NEED_CHOICE" and told["pick"] is not None and 1 <= told["pick"] <= len(session.specs(gate)):
            return "CHAT-CONFIRM", self._step("choose", num=float(told["pick"] - 1))
        if status == "NEED_READING" and gate["type"] == "boolean" and (answers["yes"] or answers["no"]):
            return "TURN", self._step("read", flag=bool(answers["yes"]))
        if plan := self._plan(told, status, gate):
            session.facts["proposed"] = dict.fromkeys(("gate", "num", "flag", "unit", "state", "low", "high", "text", "readings", "value")) | plan
            return "CHAT-CONFIRM", []
        if answers["question"] and not told["readings"] and not told["codes"]:
            return "CHAT-Q", []
        return "TURN", []

    def _plan(self, told: dict, status: str, gate: dict | None) -> dict | None:
        """What a turn proposes: limits where these are waited for, else each reading with its gate, and codes."""
        if status == "TERMINAL" or not told["readings"] and not told["codes"]:
            return None
        values = [r["value"] for r in told["readings"]]
        if status == "NEED_SPEC" and values:
            if gate["type"] == "threshold":
                return {"low": values[0], "high": values[0]}
            if gate["type"] == "window" and len(values) >= 2:
                return dict(zip(("low", "high"), sorted(values[:2])))
        facts = self.session.facts
        # a reading that is held may be told anew, one of the current gate that waits for its limits may not
        read = {facts["at"]} & facts["values"].keys()
        open_gates = [g for name, g in self.session.gates.items() if name not in facts["passed"] and name not in read]
        readings = []
        for r in told["readings"]:
            ranked = sorted(((self.score(g, r), g["id"]) for g in open_gates), reverse=True)
            if ranked and ranked[0][0] >= 0 and (len(ranked) < 2 or ranked[1][0] < ranked[0][0] or ranked[0][1] == facts["at"]):
                readings.append({"gate": ranked[0][1], "num": r["value"], "flag": None, "unit": r["unit"], "state": r["state"]})
        codes = " ".join(told["codes"])
        return {"readings": readings or None, "text": codes or None} if readings or codes else None

    def score(self, gate: dict, reading: dict) -> float:
        """How well a reading fits a gate: two for its state, one for each shared word, half for the current gate."""
        wrong_unit = reading["unit"] and reading["unit"].casefold() != (gate.get("unit") or "").casefold()
        if gate["type"] == "boolean" or wrong_unit or reading["state"] and reading["state"] != gate.get("condition"):
            return -1e9
        words = set(WORD.findall(reading["clause"].lower()))
        shared = len(words & set(WORD.findall((gate.get("quantity") or "").lower())))
        return shared + 2.0 * bool(reading["state"]) + 0.5 * (gate["id"] == self.session.facts["at"])


class Turns(StatefulProcessor):
    """Talk as keyed state."""

    def __init__(self, packs: dict[str, dict], silence: int | None, ttl: int | None):
        self.packs, self.silence, self.ttl = packs, silence, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE, self.ttl)
        self.maps = {name: handle.getMapState(name, "gate string", schema, self.ttl) for name, schema in MAPS.items()}
        self.codes = handle.getListState("codes", "code string", self.ttl)
        self.proposed = handle.getListState("proposed", PROPOSED, self.ttl)

    def _load(self) -> Talk:
        pack, at, noted, turn, make, model, year, known = self.place.get()
        vehicle = (make, model, year) if known else None
        if pack is None:
            talk = Talk(self.packs, None, None, vehicle)
            talk.turn = turn
            return talk
        own = {name: {k[0]: tuple(v) for k, v in state.iterator()} for name, state in self.maps.items()}
        facts = {
            "at": at, "open": True, "turn": turn, "noted": noted, "codes": [r[0] for r in self.codes.get()], "acked": list(own["acked"]), "proposed": None,
            "values": {k: flag if num is None else num for k, (num, flag) in own["values"].items()}, "passed": {k: v[0] for k, v in own["passed"].items()},
            "operator": {k: dict(zip(("value", "min", "max"), v)) for k, v in own["operator"].items()}, "chosen": {k: v[0] for k, v in own["chosen"].items()},
        }
        rows = [tuple(r) for r in self.proposed.get()]
        if rows:
            plan = dict.fromkeys(("gate", "num", "flag", "unit", "state", "low", "high", "text", "readings", "value"))
            for kind, gate, num, flag, unit, state, low, high, text in rows:
                if kind == "reading":
                    plan["readings"] = [*(plan["readings"] or []), dict(zip(READING, (gate, num, flag, unit, state)))]
                else:
                    plan |= {"low": low, "high": high, "text": text}
            facts["proposed"] = plan
        return Talk(self.packs, pack, facts, vehicle)

    @staticmethod
    def _stored(talk: Talk) -> dict[str, object]:
        """A talk's states as plain rows."""
        facts = talk.session.facts if talk.session else None
        make, model, year = talk.vehicle or (None, None, None)
        stored: dict[str, object] = {"place": (talk.pack, facts and facts["at"], bool(facts and facts["noted"]), talk.turn, make, model, year, talk.vehicle is not None)}
        if facts is None:
            return stored | {name: {} for name in MAPS} | {"codes": [], "proposed": []}
        stored |= {
            "values": {k: (None, v) if isinstance(v, bool) else (float(v), None) for k, v in facts["values"].items()}, "passed": {k: (v,) for k, v in facts["passed"].items()},
            "operator": {k: (v["value"], v["min"], v["max"]) for k, v in facts["operator"].items()}, "chosen": {k: (v,) for k, v in facts["chosen"].items()}, "acked": {k: (True,) for k in facts["acked"]},
            "codes": [(c,) for c in facts["codes"]], "proposed": [],
        }
        if (plan := facts["proposed"]) is not None:
            readings = [("reading", *(r[k] for k in READING), None, None, None) for r in plan["readings"] or []]
            stored["proposed"] = [*readings, ("rest", None, None, None, None, None, plan["low"], plan["high"], plan["text"])]
        return stored

    def _save(self, before: dict, after: dict) -> None:
        """Write what has changed. A session that has begun anew loses the rest."""
        if after["place"] != before.get("place"):
            self.place.update(after["place"])
        for name, state in self.maps.items():
            old, new = before.get(name, {}), after[name]
            for gate in old.keys() - new.keys():
                state.removeKey((gate,))
            for gate, value in new.items():
                if old.get(gate) != value:
                    state.updateValue((gate,), value)
        for name, state in (("codes", self.codes), ("proposed", self.proposed)):
            if after[name] != before.get(name, []):
                state.put(after[name]) if after[name] else state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.place.exists()
        talk = self._load() if known else Talk(self.packs, None)
        before = self._stored(talk) if known else {}
        for row in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0)):
            turn = row["turn"]
            if turn is None or turn <= talk.turn:
                found = "TURN", [], "no turn" if turn is None else "late turn", None, None
            else:
                if self.silence is not None and talk.turn >= 0 and turn - talk.turn > self.silence:
                    talk = Talk(self.packs, None)
                talk.turn = turn
                if talk.session:
                    talk.session.facts["turn"] = turn
                try:
                    found = talk.take(unpacked(row["told"]))
                except Exception as wrong:  # one turn must not end the sessions of a stream
                    found = "TURN", [], f"{type(wrong).__name__}: {wrong}", None, None
                if talk.session:
                    talk.session.facts["turn"] = turn
            context, commits, problem, asks, width = found
            status = talk.session.status() if talk.session else "INTAKE"
            yield Row(session=key[0], turn=turn, context=context, commits=commits, problem=problem, status=status, gate=talk.session.facts["at"] if talk.session else None, asks=asks, width=width)
        self._save(before, self._stored(talk))

    def close(self) -> None:
        pass


def turn_stream(turns: DataFrame, packs: list[dict], silence: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A row per turn (OUTPUT) of a stream of turns; packs in the order in which their symptoms are looked for."""
    rows = packed(said(turns, {p["id"]: p["symptoms"] for p in packs}))
    processor = Turns({p["id"]: p for p in packs}, silence, ttl_ms)
    return rows.groupBy("session").transformWithState(processor, OUTPUT, "append", "processingTime" if ttl_ms else "none")


def run_turns(stream: DataFrame, path: str, checkpoint: str, one_batch: bool = False) -> None:
    """Append the rows of turn_stream to a Parquet table, for what has arrived by now. Its state is kept in RocksDB, whatever else the session uses.

    one_batch: all that has arrived as one batch. A stream with a ttl needs it here, since it always has another batch to run.
    """
    conf, name = SparkSession.active().conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
    finally:
        conf.set(name, before)
    run.awaitTermination()


def snippets(events: DataFrame, chunks: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """session, turn, place, key and snippet: the k best chunks for what each row asks, as one line of at most its width. Equal questions are searched once."""
    asked = events.filter(F.col("asks").isNotNull() & (F.col("asks") != "")).select("session", "turn", "asks", "width")
    questions = asked.select(F.sha2("asks", 256).alias("query_id"), F.col("asks").alias("query")).distinct()
    found = bm25(questions, chunks, key, text, k, stem=True).select("query_id", key, "place")
    texts = chunks.select(key, F.array_join(F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != ""), " ").alias("line"))
    rows = asked.withColumn("query_id", F.sha2("asks", 256)).join(found, "query_id").join(texts, key)
    return rows.select("session", "turn", "place", key, F.substring("line", F.lit(1), F.col("width")).alias("snippet"))


def newest(events: DataFrame, cap: int = 200) -> DataFrame:
    """The rows of the cap sessions that were turned to last; ties by name."""
    last = events.filter(F.col("turn").isNotNull()).groupBy("session").agg(F.max("turn").alias("last"))
    kept = last.orderBy(F.desc("last"), "session").limit(cap).select(F.col("session").alias("kept"))
    return events.join(F.broadcast(kept) if cap <= 10_000 else kept, F.col("session") == F.col("kept"), "left_semi")

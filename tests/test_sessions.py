import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import gates
from quarry.plans.gates import PACK, gate
from quarry.streaming import turns
from quarry.streaming.sessions import EVENT, KINDS, OUTPUT, Session, append_ledger, session_stream


def event(turn, kind, gate=None, **more):
    return {"turn": turn, "kind": kind, "gate": gate} | more


RISKY = {
    "id": "p", "start": "CODES", "terminals": {"OK": ""},
    "gates": [
        gate("CODES", "boolean", {"YES": "BATT", "NO": "BATT"}, captures_dtcs=True),
        gate("BATT", "threshold", {"PASS": "WIRE", "FAIL": "TERMINAL-OK"}, ">=", {"value": 12.0}, cuts_power=True, risk="sparks"),
        gate("WIRE", "window", {"LOW": "TERMINAL-OK", "PASS": "TERMINAL-OK", "HIGH": "TERMINAL-OK"}),
    ],
}


def test_protocol():
    w = Session(RISKY)
    assert w.status() == "INTAKE"
    assert w.handle(event(0, "read", flag=True)) == ([], "not ready for a reading")
    w.handle(event(1, "intake"))
    assert w.handle(event(2, "read", num=1.0)) == ([], "wrong kind of reading")
    assert w.handle(event(3, "hold", "BATT", num=12.6, unit="v")) == (["DEV-BRANCH-PENDING-BATT"], None)
    assert w.handle(event(4, "read", flag=False)) == (["DEV-BRANCH-GATE-CODES-NO"], None)
    assert w.status() == "NEED_DTCS"
    assert w.handle(event(5, "codes", text="p0101 P0101 u0100")) == ([], None) and w.facts["codes"] == ["P0101", "U0100"] and w.status() == "NEED_DTCS"
    assert w.handle(event(6, "codes_captured")) == ([], None) and w.status() == "NEED_ACK"
    assert w.handle(event(6, "ack")) == ([], "late turn")
    assert w.handle(event(7, "ack")) == (["DEV-BRANCH-RISK-ACK-BATT", "DEV-BRANCH-GATE-BATT-PASS"], None)
    assert w.handle(event(8, "hold", "BATT", num=1.0)) == ([], "nothing to hold that for")
    assert w.handle(event(9, "read", num=3.0, unit="ohm")) == ([], "wrong unit") and w.handle(event(10, "read", num=3.0, state="RUNNING")) == ([], "wrong condition")
    assert w.handle(event(11, "read", num=3.0, unit="V")) == ([], None) and w.status() == "NEED_SPEC"
    assert w.handle(event(12, "spec", low=1.0)) == ([], "that is no limit for this gate") and w.handle(event(13, "spec")) == ([], "that is no limit for this gate")
    assert w.handle(event(14, "spec", low=1.0, high=2.0)) == (["DEV-BRANCH-GATE-WIRE-HIGH", "DEV-BRANCH-TERMINAL-OK"], None)
    assert w.status() == "TERMINAL"
    for kind in ("read", "spec", "choose", "ack", "hold", "nonsense", None):
        assert w.handle(event(w.facts["turn"] + 1, kind, num=1.0))[0] == []


def test_a_capturing_yes_notes_the_codes():
    w = Session(RISKY, intake=False)
    assert w.handle(event(0, "read", flag=True)) == (["DEV-BRANCH-GATE-CODES-YES"], None) and w.status() == "NEED_ACK"


CONFLICT = {
    "id": "c", "start": "A", "terminals": {"OK": ""},
    "gates": [gate("A", "threshold", {"PASS": "B", "FAIL": "TERMINAL-OK"}, "<=", candidates=[{"value": 5.0}, {"value": 9.0}]), gate("B", "threshold", {"PASS": "TERMINAL-OK", "FAIL": "TERMINAL-OK"}, ">", candidates=[{"value": 1.0}, {"value": 2.0}])],
}


def test_conflicting_specs_wait_for_a_choice_or_the_operators_own():
    w = Session(CONFLICT, intake=False)
    assert w.handle(event(0, "read", num=7.0)) == ([], None) and w.status() == "NEED_CHOICE"
    assert w.handle(event(1, "choose", num=2.0)) == ([], "no such choice") and w.handle(event(2, "choose")) == ([], "no such choice") and w.handle(event(3, "choose", num=0.5)) == ([], "no such choice")
    assert w.handle(event(4, "choose", num=1.0)) == (["DEV-BRANCH-GATE-A-PASS"], None)
    w.handle(event(5, "read", num=1.5))
    assert w.status() == "NEED_CHOICE" and w.handle(event(6, "spec", num=1.6)) == (["DEV-BRANCH-GATE-B-FAIL", "DEV-BRANCH-TERMINAL-OK"], None)


def test_a_proposal_counts_only_with_a_yes_right_behind_it():
    w = Session(PACK, intake=False)
    assert w.handle(event(0, "yes")) == ([], "nothing to confirm")
    assert w.handle(event(1, "propose", num=9.0, unit="V")) == ([], None) and w.status() == "NEED_READING"
    assert w.handle(event(2, "codes", text="P0001")) == ([], None) and w.handle(event(3, "yes")) == ([], "nothing to confirm")
    assert w.handle(event(4, "propose", num=9.0, unit="ohm")) == ([], "wrong unit") and w.handle(event(5, "yes")) == ([], "nothing to confirm")
    w.handle(event(6, "propose", num=9.0))
    assert w.handle(event(7, "yes")) == (["DEV-BRANCH-GATE-VIEW-PASS"], None)
    w.handle(event(8, "propose", "PURCHASE", flag=True))
    assert w.handle(event(9, "yes")) == (["DEV-BRANCH-PENDING-PURCHASE"], None) and w.handle(event(10, "yes")) == ([], "nothing to confirm")
    assert w.handle(event(11, "read", num=20.0))[0] == ["DEV-BRANCH-GATE-CLICK-PASS", "DEV-BRANCH-GATE-PURCHASE-YES", "DEV-BRANCH-TERMINAL-DONE"]


def test_a_proposal_of_several_readings_codes_and_a_spec():
    """Applied together: codes, then the spec, then each reading for its gate; what cannot be applied is told and keeps nothing back."""
    w = Session(RISKY, intake=False)
    readings = [{"gate": "CODES", "flag": False}, {"gate": "BATT", "num": 12.5, "unit": "V"}, {"gate": "WIRE", "num": 3.0}]
    assert w.handle(event(0, "propose", text="p0420 P0420", readings=readings)) == ([], None) and w.facts["codes"] == []
    commits, problem = w.handle(event(1, "yes"))
    assert commits == ["DEV-BRANCH-GATE-CODES-NO", "DEV-BRANCH-PENDING-BATT", "DEV-BRANCH-PENDING-WIRE"] and problem is None and w.facts["codes"] == ["P0420"]
    w.handle(event(2, "codes_captured"))
    assert w.handle(event(3, "ack"))[0] == ["DEV-BRANCH-RISK-ACK-BATT", "DEV-BRANCH-GATE-BATT-PASS"] and w.status() == "NEED_SPEC"
    assert w.handle(event(4, "propose", low=1.0, high=2.0)) == ([], None)
    assert w.handle(event(5, "yes"))[0] == ["DEV-BRANCH-GATE-WIRE-HIGH", "DEV-BRANCH-TERMINAL-OK"]
    w = Session(PACK, intake=False)
    w.handle(event(0, "propose", readings=[{"gate": "VIEW", "num": 9.0}, {"gate": "VIEW", "num": 8.0}, {"gate": "PURCHASE", "flag": True}]))
    assert w.handle(event(1, "yes")) == (["DEV-BRANCH-GATE-VIEW-PASS", "DEV-BRANCH-PENDING-PURCHASE"], "nothing to hold that for")
    assert w.handle(event(2, "propose"))[1] == "nothing is proposed" and w.handle(event(3, "propose", readings=[{"gate": "X", "num": 1.0}]))[1] == "no such gate"


def test_bands_and_columns_agree(spark):
    """The keyed state's rule and the column expression, at, between and beyond the limits, with and without them."""
    numbers = [-1.0, 0.0, 1.0, 1.5, 2.0, 3.0]
    specs = [(v, a, b) for v in (None, 1.0) for a in (None, 1.0) for b in (None, 2.0)]
    rows = [("window", None, n, *s) for n in numbers for s in specs] + [("threshold", op, n, *s) for op in gates.OPS for n in numbers for s in specs]
    df = spark.createDataFrame(rows, "kind string, op string, num double, value double, vmin double, vmax double")
    got = df.select("*", gates.evaluate("kind", "op", "num", F.lit(None).cast("boolean"), "value", "vmin", "vmax").alias("o")).collect()
    for r in got:
        assert r.o == gates.band(r.kind, r.op, {"value": r.value, "min": r.vmin, "max": r.vmax}, r.num), r


SCHEMA = "session string, turn long, kind string, gate string, num double, flag boolean, unit string, state string"


def test_stream_in_two_runs_equals_one_walk(spark, tmp_path):
    """The first half of the turns, a restart from the stored state, then the second half: the same ledger as one walk, row by row."""
    script = [("intake", None, None, None), ("read", "VIEW", 9.0, None), ("hold", "PURCHASE", None, True), ("spec", None, None, None), ("nonsense", None, None, None), ("read", "CLICK", 20.0, None)]
    rows = [(s, t, k, g, n, f, None, None) for s in ("a", "b", None) for t, (k, g, n, f) in enumerate(script)]
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    for low, high in ((0, 3), (3, 6)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        append_ledger(session_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), PACK), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = {(r.session, r.turn): (r.commits, r.problem, r.status, r.gate) for r in spark.read.schema(OUTPUT).parquet(f"{folder}/out").collect()}
    want = {}
    for s in ("a", "b", None):
        walk = Session(PACK)
        for t, (k, g, n, f) in enumerate(script):
            commits, wrong = walk.handle(event(t, k, g, num=n, flag=f))
            want[s, t] = (commits, wrong, walk.status(), walk.facts["at"])
    assert got == want and want["a", 5][0][-1] == "DEV-BRANCH-TERMINAL-DONE" and want["a", 3][1] and want["a", 4][1] == "unknown kind of event"


@pytest.mark.parametrize("kind, values, expected", [("window", [3.0, 1.0], (None, 1.0, 3.0)), ("threshold", [2.0], (2.0, None, None)), ("window", [1.0], None), ("threshold", [3.0, 1.0, 2.0], (3.0, None, None)), ("window", [5.0, 1.0, 0.5, 9.0], (None, 1.0, 5.0)), ("threshold", [], None), ("window", None, None), ("boolean", [1.0], None), ("window", [], None)])
def test_captured_spec(spark, kind, values, expected):
    got = spark.createDataFrame([(kind, values)], "k string, v array<double>").select(gates.captured_spec("k", "v").alias("s")).first()["s"]
    assert got == expected if expected is None else tuple(got) == expected


def test_unsound_ledgers_are_seen(spark):
    from quarry.plans import registry

    folder = "/root/testdata/sf0.01"
    got = {r.sound for r in registry.QUERIES["ledger_replay"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert got == {True, False} == {r[0] for r in con.sql(f"SELECT DISTINCT sound FROM ({registry.ORACLE_SQL['ledger_replay']})").fetchall()}


ODD = [None, float("nan"), float("inf"), float("-inf"), -1.0, 1e300]


def test_no_event_ends_the_stream(spark, tmp_path):
    """Nulls, NaN and infinities in every field, and events without turn or kind: a row each, and sessions go on."""
    kinds = [*KINDS, "nonsense", None]
    rows, turn = [], 0
    for session in ("a", None):
        for kind in kinds:
            for x in ODD:
                rows.append((session, None if turn % 5 == 4 else turn, kind, None if turn % 2 else "CLICK", x, x, x, [("VIEW", x, None)] if turn % 3 == 0 else None))
                turn += 1
        rows.append((session, 2**62 + 1, "intake", None, None, None, None, None))
        rows.append((session, 2**62 + 2, "read", None, 7.0, None, None, None))
    schema = "session string, turn long, kind string, gate string, num double, low double, high double, readings array<struct<gate string, num double, flag boolean>>"
    spark.createDataFrame(rows, schema).withColumn("readings", F.col("readings").cast(EVENT["readings"].replace(", unit string, state string", ""))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    stream = stream.withColumn("readings", F.transform("readings", lambda r: F.struct(r["gate"].alias("gate"), r["num"].alias("num"), r["flag"].alias("flag"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("state"))))
    append_ledger(session_stream(stream, PACK), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(rows) and sorted(map(str, (r.turn for r in got))) == sorted(str(r[1]) for r in rows)
    assert all(r.problem == "no turn" for r in got if r.turn is None)
    assert not any((r.problem or "").startswith(("TypeError", "OverflowError", "KeyError")) for r in got)
    assert {r.gate for r in got if r.turn == 2**62 + 2} != {"VIEW"}


BENCH = RISKY | {
    "id": "bench", "symptoms": ["no start", "cranks but"],
    "gates": [
        RISKY["gates"][0] | {"title": "Codes", "quantity": "codes"},
        RISKY["gates"][1] | {"title": "Battery", "quantity": "battery voltage", "unit": "V", "condition": "KOEO"},
        RISKY["gates"][2] | {"title": "Wire", "quantity": "wire resistance", "unit": "ohm", "condition": "KEY_OFF"},
    ],
}

#: Text, and what it leads to: context, commits, status, gate.
SCRIPT = [
    ("hello there", ("INTAKE", [], "INTAKE", None)),
    ("1998 Acme Roadster, no start", ("TURN", [], "NEED_READING", "CODES")),
    ("what is a ground strap?", ("CHAT-Q", [], "NEED_READING", "CODES")),
    ("battery reads 12.6 V key on", ("CHAT-CONFIRM", [], "NEED_READING", "CODES")),
    ("what now", ("TURN", [], "NEED_READING", "CODES")),
    ("battery reads 12.4 V key on, wire is 3 ohm, p0420", ("CHAT-CONFIRM", [], "NEED_READING", "CODES")),
    ("yes", ("CHAT-CONFIRM", ["PENDING-BATT", "PENDING-WIRE"], "NEED_READING", "CODES")),
    ("battery reads 12.2 V key on", ("CHAT-CONFIRM", [], "NEED_READING", "CODES")),
    ("ok", ("CHAT-CONFIRM", ["PENDING-BATT"], "NEED_READING", "CODES")),
    ("no", ("TURN", ["GATE-CODES-NO"], "NEED_DTCS", "BATT")),
    ("dtcs captured", ("TURN", [], "NEED_ACK", "BATT")),
    ("ack", ("TURN", ["RISK-ACK-BATT", "GATE-BATT-PASS"], "NEED_SPEC", "WIRE")),
    ("it says 5 ohm to 1 ohm", ("CHAT-CONFIRM", [], "NEED_SPEC", "WIRE")),
    ("nope", ("CHAT-CONFIRM", [], "NEED_SPEC", "WIRE")),
    ("it says 5 ohm to 1 ohm", ("CHAT-CONFIRM", [], "NEED_SPEC", "WIRE")),
    ("yes", ("CHAT-CONFIRM", ["GATE-WIRE-PASS", "TERMINAL-OK"], "TERMINAL", "TERMINAL-OK")),
    ("reads 3 ohm", ("TURN", [], "TERMINAL", "TERMINAL-OK")),
]


@pytest.mark.parametrize("cuts", [(0, 17), (0, 6, 13, 17)])
def test_turns_of_a_script(spark, tmp_path, cuts):
    """One script for two sessions, in one run or with restarts in the middle of proposals: contexts, commits, statuses and gates, row by row."""
    for low, high in zip(cuts, cuts[1:]):
        rows = [(s, t, SCRIPT[t][0]) for t in range(low, high) for s in ("a", "b")] + [("c", None, "no start"), ("d", low, None)]
        spark.createDataFrame(rows, "session string, turn long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("session string, turn long, text string").parquet(f"{tmp_path}/in")
        turns.run_turns(turns.turn_stream(stream, [BENCH]), f"{tmp_path}/out", f"{tmp_path}/state")
    events = spark.read.schema(turns.OUTPUT).parquet(f"{tmp_path}/out")
    got = events.collect()
    for s in ("a", "b"):
        own = {r.turn: (r.context, [c.removeprefix("DEV-BRANCH-") for c in r.commits], r.status, r.gate) for r in got if r.session == s}
        assert own == {t: want for t, (_, want) in enumerate(SCRIPT)} and not any(r.problem for r in got if r.session == s)
    assert {r.problem for r in got if r.session == "c"} == {"no turn"} and {r.status for r in got if r.session == "d"} == {"INTAKE"}
    chunks = spark.createDataFrame([("m p.1", "The  ground\nstrap " + "long " * 90), ("m p.2", "Battery voltage, measured."), ("m p.3", "Codes here.")], "cite string, text string")
    found = {(r.turn, r.place): r for r in turns.snippets(events.filter("session = 'a'"), chunks, "cite", "text").collect()}
    assert found[2, 1].snippet == ("The ground strap " + "long " * 90)[:240] and found[1, 1].cite == "m p.3" and (6, 1) in found and (11, 1) not in found
    assert {r.session for r in turns.newest(events, 2).collect()} == {"a", "b"}


def test_silence_ends_a_session(spark, tmp_path):
    rows = [("a", 0, "no start"), ("a", 3, "battery reads 12 V"), ("a", 9, "yes"), ("a", 10, "no start"), ("a", 12, "no")]
    spark.createDataFrame(rows, "session string, turn long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, turn long, text string").parquet(f"{tmp_path}/in")
    turns.run_turns(turns.turn_stream(stream, [BENCH], silence=5, ttl_ms=60_000), f"{tmp_path}/out", f"{tmp_path}/state", one_batch=True)
    got = {r.turn: (r.status, [c.removeprefix("DEV-BRANCH-") for c in r.commits]) for r in spark.read.schema(turns.OUTPUT).parquet(f"{tmp_path}/out").collect()}
    assert got == {0: ("NEED_READING", []), 3: ("NEED_READING", []), 9: ("INTAKE", []), 10: ("NEED_READING", []), 12: ("NEED_DTCS", ["GATE-CODES-NO"])}


def test_what_is_said_travels_as_one_text(spark, tmp_path):
    """A worker gets three cells a turn, whatever is said; a vehicle is kept by its values, and a number beyond all doubles ends nothing."""
    rows = [("a", 0, "2008 Honda Civic no start"), ("a", 1, "battery reads " + "9" * 400 + " V"), ("a", 2, "no"), ("b", 0, None)]
    spark.createDataFrame(rows, "session string, turn long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, turn long, text string").parquet(f"{tmp_path}/in")
    assert turns.packed(turns.said(stream, {})).columns == ["session", "turn", "told"]
    turns.run_turns(turns.turn_stream(stream, [BENCH]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.session, r.turn): (r.status, r.problem) for r in spark.read.schema(turns.OUTPUT).parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0): ("NEED_READING", None), ("a", 1): ("NEED_READING", None), ("a", 2): ("NEED_READING", None), ("b", 0): ("INTAKE", None)}
    talk = turns.Talk({}, None)
    talk.take({"vehicle": {"make": "Honda", "model": "Civic", "year": 2008}, "pack": None, "text": "x"})
    assert talk.vehicle == ("Honda", "Civic", 2008)

"""Queries for specs, packs and gate sessions, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.gates import captured_spec, evaluate, parse_token, reading_problem, token
from quarry.operators import merge, packs, sessions, specs
from quarry.operators.shared import shared_dir
from quarry.streaming.sessions import OUTPUT, append_ledger, session_stream

from .entities import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def gate(name: str, kind: str, following: dict[str, str], op: str | None = None, spec: dict | None = None, **more) -> dict:
    own = {"id": name, "type": kind, "title": name.title(), "quantity": f"{name.lower()} value", "condition": None if kind == "boolean" else "KOEO", "unit": None if kind == "boolean" else "V", "op": op, "spec_ref": None, "literal": spec and {"unit": "V", "cite": "manual.pdf p.1", **spec}, "instruction": "Measure it.", "safeguard": "Take care.", "risk": None, "cuts_power": None, "captures_dtcs": None, "next": following}
    return own | more


PACK = {
    "id": "events_pack", "title": "Events", "ecu_family": "", "symptoms": ["event"], "start": "VIEW", "terminals": {"DONE": "All good.", "STOP": "Stop here."},
    "gates": [
        gate("VIEW", "threshold", {"PASS": "CLICK", "FAIL": "ERROR"}, ">=", {"value": 5.0}),
        gate("CLICK", "window", {"LOW": "ERROR", "PASS": "PURCHASE", "HIGH": "TERMINAL-STOP"}, None, {"min": 2.0, "max": 40.0}),
        gate("ERROR", "threshold", {"PASS": "PURCHASE", "FAIL": "TERMINAL-STOP"}, "<", {"value": 30.0}),
        gate("PURCHASE", "boolean", {"YES": "TERMINAL-DONE", "NO": "TERMINAL-STOP"}),
    ],
}
def _broken_packs() -> list[str]:
    """Eleven packs as JSON, each but the first with one fault; @ stands for the supplier's key."""
    own = {
        "id": "p@", "title": "Two gates", "ecu_family": "", "symptoms": ["no start"], "start": "A", "terminals": {"DONE": "All good."},
        "gates": [gate("A", "threshold", {"PASS": "B", "FAIL": "TERMINAL-DONE"}, ">=", {"value": 5.0}), gate("B", "boolean", {"YES": "TERMINAL-DONE", "NO": "TERMINAL-DONE"})],
    }
    first = lambda **more: {"gates": [own["gates"][0] | more, own["gates"][1]]}
    last = lambda **more: {"gates": [own["gates"][0], own["gates"][1] | more]}
    faults = [
        {}, {"id": "p @"}, {"start": "Z"}, first(unit=""), first(op="="), first(instruction="Wait 5 minutes."), last(next={"YES": "TERMINAL-DONE"}),
        first(next={"PASS": "C", "FAIL": "TERMINAL-DONE"}), {"symptoms": ["no start", "(crank"]}, {"gates": [*own["gates"], gate("LOST", "boolean", {"YES": "A", "NO": "B"})]},
        last(next={"YES": "A", "NO": "TERMINAL-DONE"}),
    ]
    return [json.dumps(own | f) for f in faults]


def pack_rows(spark: SparkSession) -> DataFrame:
    """The events' pack, by the schema that pack files are read with."""
    return spark.createDataFrame([(json.dumps(PACK),)], "value string").select(F.from_json("value", packs.PACK_SCHEMA).alias("p")).select("p.*")


@query("""WITH faults(kind, gate, problem) AS (VALUES (1, NULL, 'pack id missing or invalid'), (2, NULL, 'start gate does not exist'), (3, 'A', 'numeric gate needs a unit'), (4, 'A', 'threshold needs an op'), (5, 'A', 'digits in instruction'), (6, 'B', 'next must map exactly the outcomes'),
(7, 'A', 'PASS -> neither gate nor terminal'), (8, NULL, 'bad symptom pattern'), (9, 'LOST', 'unreachable from start'), (10, 'A', 'on or before a cycle'), (10, 'B', 'on or before a cycle'))
SELECT CASE WHEN kind = 1 THEN 'p ' ELSE 'p' END || CAST(s_suppkey AS VARCHAR) AS pack, gate, problem FROM supplier JOIN faults ON kind = s_suppkey % 11""")
def pack_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each supplier, with a fault by its key."""
    key = F.col("s_suppkey")
    text = F.replace(F.element_at(F.array(*map(F.lit, _broken_packs())), (key % 11 + 1).cast("int")), F.lit("@"), key.cast("string"))
    rows = table(spark, sf_dir, "supplier").select(F.from_json(text, packs.PACK_SCHEMA).alias("p")).select("p.*")
    return packs.problems(rows).select("pack", "gate", "problem")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT o_custkey % 4 AS pack, o_custkey AS gate, (o_custkey * 7 + o_orderkey % 3 * 11) % 1500 AS target FROM orders),
seen AS (SELECT CAST(p AS BIGINT) AS pack, CAST(p AS BIGINT) AS gate FROM range(4) r(p) UNION SELECT s.pack, target FROM seen s JOIN edges e ON e.pack = s.pack AND e.gate = s.gate)
SELECT pack, count(*) AS n, CAST(sum(gate) AS BIGINT) AS gates FROM (SELECT DISTINCT s.pack, s.gate FROM seen s JOIN edges e ON e.pack = s.pack AND e.gate = s.gate) GROUP BY 1""")
def pack_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over a large graph of orders: customers lead to customers."""
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    edges = table(spark, sf_dir, "orders").select((customer % 4).alias("pack"), customer.alias("gate"), ((customer * 7 + order % 3 * 11) % 1500).alias("target")).distinct()
    seen = spark.range(4).select(F.col("id").alias("pack"), F.col("id").alias("gate"))
    found = packs.closure(seen, edges)
    own = edges.select("pack", "gate").distinct()
    return found.join(own, ["pack", "gate"], "left_semi").groupBy("pack").agg(F.count("*").alias("n"), F.sum("gate").alias("gates"))


EVALUATE = """CASE type WHEN 'boolean' THEN CASE WHEN flag THEN 'YES' WHEN NOT flag THEN 'NO' END WHEN 'window' THEN CASE WHEN num < vmin THEN 'LOW' WHEN num > vmax THEN 'HIGH' WHEN num IS NOT NULL THEN 'PASS' END
  ELSE CASE WHEN (op = '>=' AND num >= v) OR (op = '<' AND num < v) THEN 'PASS' WHEN num IS NOT NULL THEN 'FAIL' END END"""


@query("""SELECT event_id, outcome FROM (SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN value >= 5 THEN 'PASS' ELSE 'FAIL' END WHEN 'click' THEN CASE WHEN value < 2 THEN 'LOW' WHEN value > 40 THEN 'HIGH' ELSE 'PASS' END
WHEN 'error' THEN CASE WHEN value < 30 THEN 'PASS' ELSE 'FAIL' END WHEN 'purchase' THEN CASE WHEN value > 10 THEN 'YES' ELSE 'NO' END END AS outcome FROM events) WHERE outcome IS NOT NULL""")
def gate_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).join(F.broadcast(_gates(spark)), "gate")
    return rows.select("event_id", evaluate("type", "op", "num", "flag", "value", "vmin", "vmax").alias("outcome")).filter("outcome is not null")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    return rows.select("event_id", F.col("user_id").alias("session"), F.upper(kind).alias("gate"), (F.col("event_id") + 1).alias("ord"), F.when(kind != "purchase", F.col("value")).alias("num"), F.when(kind == "purchase", F.col("value") > 10).alias("flag"))


def _gates(spark: SparkSession) -> DataFrame:
    own = pack_rows(spark)
    return packs.gates_of(own).select(F.col("id").alias("gate"), "type", "op", "literal.value", F.col("literal.min").alias("vmin"), F.col("literal.max").alias("vmax"), "next")


STEP = f"""near{{k}} AS (SELECT p.session, p.gate, p.arrival, coalesce(max(r.ord) FILTER (r.ord <= p.arrival), min(r.ord) FILTER (r.ord > p.arrival)) AS pick FROM place{{k}} p JOIN readings r ON r.session = p.session AND r.gate = p.gate GROUP BY 1, 2, 3),
done{{k}} AS (SELECT session, {{k}} AS step, gate, greatest(arrival, pick) AS ord, outcome, (SELECT target FROM edges WHERE edges.gate = x.gate AND edges.outcome = x.outcome) AS target FROM (SELECT n.*, {EVALUATE} AS outcome FROM near{{k}} n JOIN readings r ON r.session = n.session AND r.gate = n.gate AND r.ord = n.pick JOIN gates g ON g.gate = n.gate) x),
place{{n}} AS (SELECT session, target AS gate, ord AS arrival FROM done{{k}} WHERE NOT starts_with(target, 'TERMINAL'))"""
LEDGER = (
    """WITH readings AS (SELECT user_id AS session, upper(event_type) AS gate, event_id + 1 AS ord, CASE WHEN event_type <> 'purchase' THEN value END AS num, CASE WHEN event_type = 'purchase' THEN value > 10 END AS flag FROM events WHERE event_type <> 'signup'),
gates(gate, type, op, v, vmin, vmax) AS (VALUES ('VIEW', 'threshold', '>=', 5.0, NULL, NULL), ('CLICK', 'window', NULL, NULL, 2.0, 40.0), ('ERROR', 'threshold', '<', 30.0, NULL, NULL), ('PURCHASE', 'boolean', NULL, NULL, NULL, NULL)),
edges(gate, outcome, target) AS (VALUES """
    + ", ".join(f"('{g['id']}', '{o}', '{t}')" for g in PACK["gates"] for o, t in g["next"].items())
    + "),\nplace0 AS (SELECT DISTINCT session, 'VIEW' AS gate, CAST(0 AS BIGINT) AS arrival FROM readings),\n"
    + ",\n".join(STEP.replace("{k}", str(k)).replace("{n}", str(k + 1)) for k in range(4))
    + ",\nledger AS (" + " UNION ALL ".join(f"SELECT session, step, gate, ord, outcome, target FROM done{k}" for k in range(4)) + ")"
)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = _readings(spark, sf_dir)
    places = readings.select("session").distinct().withColumn("gate", F.lit("VIEW"))
    return sessions.walk(places, readings.drop("event_id"), _gates(spark), len(PACK["gates"]))


@query(f"{LEDGER} SELECT session, step, gate, ord, outcome, target, 'DEV-BRANCH-GATE-' || gate || '-' || outcome AS \"commit\" FROM ledger")
def gate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query(f"""{LEDGER}, kept AS (SELECT session, step, CASE WHEN session % 7 = 0 AND step = 0 THEN 'ERROR' ELSE gate END AS gate, outcome FROM ledger WHERE NOT (session % 5 = 0 AND step = 1)),
led AS (SELECT k.session, k.step, k.gate, e.target FROM kept k LEFT JOIN edges e ON e.gate = k.gate AND e.outcome = k.outcome),
expected AS (SELECT *, CASE WHEN step = first_value(step) OVER w THEN 'VIEW' ELSE coalesce(lag(target) OVER w, 'VIEW') END AS place FROM led WINDOW w AS (PARTITION BY session ORDER BY step))
SELECT session, arg_max(target, step) AS position, bool_and(target IS NOT NULL AND gate = place) AS sound FROM expected GROUP BY 1""")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's tokens, parsed again, lead back to every session's place. In some sessions a commit is missing or names another gate: they are not sound."""
    step, session = F.col("step"), F.col("session")
    told = F.when((session % 7 == 0) & (step == 0), "ERROR").otherwise(F.col("gate"))
    parsed = _ledger(spark, sf_dir).filter(~((session % 5 == 0) & (step == 1))).select("session", step.alias("ord"), parse_token(F.concat(F.lit("COMMIT: "), token(F.lit("GATE"), told, "outcome"))).alias("t"))
    commits = parsed.select("session", "ord", "t.gate", "t.outcome")
    edges = packs.edges_of(pack_rows(spark)).select("gate", "outcome", "target")
    starts = _readings(spark, sf_dir).select("session").distinct().withColumn("start", F.lit("VIEW"))
    return sessions.replay(commits, edges, starts)


RESOLVED = """WITH specs AS (SELECT p_partkey AS spec_id, p_type AS spec_key, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS make, CASE WHEN p_size % 5 = 0 THEN 1990 + p_size % 20 END AS y0, CASE WHEN p_size % 5 = 0 THEN 2000 + p_size % 20 END AS y1,
  CAST(p_size % 4 AS DOUBLE) AS value, CASE WHEN p_size % 7 = 0 THEN 'V' ELSE '' END AS unit, 'f' || CAST(p_partkey % 9 AS VARCHAR) || ' p.' || CAST(p_size AS VARCHAR) AS cite FROM part),
gates AS (SELECT s_suppkey AS gate_key, CASE s_suppkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'STANDARD' WHEN 5 THEN 'LARGE' ELSE 'NONE' END AS spec_ref, CASE WHEN s_suppkey % 2 = 0 THEN 'v' ELSE 'ohm' END AS gate_unit,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'brand#' || CAST(1 + s_suppkey % 25 AS VARCHAR) END AS asked, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1995 + s_suppkey % 10 END AS asked_year FROM supplier),
pairs AS (SELECT g.*, s.*, spec_id IS NOT NULL AND (make = '' OR (asked <> '' AND lower(make) = lower(asked))) AND (y0 IS NULL OR (asked_year IS NOT NULL AND asked_year BETWEEN y0 AND y1)) AND NOT (unit <> '' AND lower(unit) <> lower(gate_unit)) AS used FROM gates g LEFT JOIN specs s ON spec_ref = spec_key),
merged AS (SELECT gate_key, value, CASE WHEN unit = '' THEN gate_unit ELSE unit END AS u, string_agg(cite, '; ' ORDER BY spec_id) AS cite, arg_min(CASE WHEN unit = '' THEN gate_unit ELSE unit END, spec_id) AS spec_unit FROM pairs WHERE used GROUP BY gate_key, value, lower(CASE WHEN unit = '' THEN gate_unit ELSE unit END), CASE WHEN unit = '' THEN gate_unit ELSE unit END),
one AS (SELECT gate_key, count(*) AS n, any_value(value) AS value, any_value(cite) AS cite FROM (SELECT gate_key, value, lower(u) AS u, string_agg(cite, '; ') AS cite FROM (SELECT gate_key, value, CASE WHEN unit = '' THEN gate_unit ELSE unit END AS u, string_agg(cite, '; ' ORDER BY spec_id) AS cite FROM (SELECT *, lower(CASE WHEN unit = '' THEN gate_unit ELSE unit END) AS lu FROM pairs WHERE used) GROUP BY gate_key, value, lu, u) GROUP BY 1, 2, 3) GROUP BY 1),
facts AS (SELECT gate_key, count(*) FILTER (spec_id IS NOT NULL AND NOT used) AS ignored, bool_or(asked <> '' OR asked_year IS NOT NULL) AS known FROM pairs GROUP BY 1)
SELECT gate_key, CASE WHEN coalesce(n, 0) = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'CONFLICT' ELSE 'UNVERIFIED' END AS status, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN value END AS value, ignored > 0 AND NOT known AND n IS NULL AS needs_vehicle FROM facts LEFT JOIN one USING (gate_key)"""


def _specs_and_gates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    size, supplier = F.col("p_size"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("spec_id"), F.col("p_type").alias("spec_key"), F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("make"), F.lit("").alias("model"),
        F.when(size % 5 == 0, 1990 + size % 20).alias("year_start"), F.when(size % 5 == 0, 2000 + size % 20).alias("year_end"), (size % 4).cast("double").alias("value"), F.lit(None).cast("double").alias("vmin"), F.lit(None).cast("double").alias("vmax"),
        F.when(size % 7 == 0, "V").otherwise("").alias("unit"), F.concat(F.lit("f"), (F.col("p_partkey") % 9).cast("string")).alias("source_file"), size.alias("page"),
    )
    kinds = F.array(*map(F.lit, ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE", "NONE")))
    gates = table(spark, sf_dir, "supplier").select(
        supplier.alias("gate_key"), F.element_at(kinds, (supplier % 7 + 1).cast("int")).alias("spec_ref"), F.when(supplier % 2 == 0, "v").otherwise("ohm").alias("unit"),
        F.when(supplier % 3 == 0, "").otherwise(F.concat(F.lit("brand#"), (1 + supplier % 25).cast("string"))).alias("asked_make"), F.lit("").alias("asked_model"), F.when(supplier % 4 != 0, 1995 + supplier % 10).alias("asked_year"),
    )
    return rows, gates


@query(RESOLVED)
def spec_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gates = _specs_and_gates(spark, sf_dir)
    found = specs.resolve(gates, rows)
    return found.select("gate_key", "status", "n_candidates", "value", F.endswith("note", F.lit(specs.IGNORED)).alias("needs_vehicle"))


@query(RESOLVED[: RESOLVED.rindex("SELECT gate_key, CASE")] + """, every AS (SELECT gate_key, value, lower(u) AS lu, min(spec_id) AS first_id FROM (SELECT *, CASE WHEN unit = '' THEN gate_unit ELSE unit END AS u FROM pairs WHERE used) GROUP BY 1, 2, 3),
places AS (SELECT *, row_number() OVER (PARTITION BY gate_key ORDER BY first_id) - 1 AS place, count(*) OVER (PARTITION BY gate_key) AS n FROM every),
own AS (SELECT gate_key, n, max(value) FILTER (n = 1) AS alone, max(value) FILTER (place = gate_key % 3) AS picked FROM places GROUP BY 1, 2),
settled AS (SELECT f.gate_key, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN alone WHEN n > 1 THEN coalesce(picked, CASE WHEN f.gate_key % 2 = 0 THEN 9.5 END) WHEN f.gate_key % 2 = 0 THEN 9.5 END AS value FROM facts f LEFT JOIN own USING (gate_key))
SELECT gate_key, CASE WHEN value IS NOT NULL THEN 'RESOLVED' WHEN n > 1 THEN 'CONFLICT' ELSE 'UNVERIFIED' END AS status, value FROM settled""")
def spec_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conflict with a choice that may name no candidate, and for every other gate a spec of the operator's."""
    rows, gates = _specs_and_gates(spark, sf_dir)
    key = F.col("gate_key")
    choices = gates.select("gate_key", (key % 3).alias("choice"))
    none = F.lit(None).cast("double")
    operator = gates.filter(key % 2 == 0).select("gate_key", F.lit(9.5).alias("value"), none.alias("vmin"), none.alias("vmax"), "unit", F.lit("operator").alias("cite"))
    return specs.resolve(gates, rows, choices=choices, operator=operator).select("gate_key", "status", "value")


@query(f"{LEDGER} SELECT CAST(session AS VARCHAR) AS session, ord, gate, outcome FROM ledger")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions as a stream of events with keyed state, run until all has arrived: the commits of its ledger, with the place of the event that led to them."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parquet*")
    kind = F.col("event_type")
    rows = events.filter(kind != "signup").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"), F.lit("hold").alias("kind"), F.upper(kind).alias("gate"),
        F.when(kind != "purchase", F.col("value")).alias("num"), F.when(kind == "purchase", F.col("value") > 10).alias("flag"),
    )
    folder = shared_dir(spark, "stream")
    append_ledger(session_stream(rows, PACK, intake=False), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    ledger = spark.read.schema(OUTPUT).parquet(f"{folder}/ledger").select("session", (F.col("turn") + 1).alias("ord"), F.explode("commits").alias("commit"))
    return ledger.select("session", "ord", parse_token(F.concat(F.lit("COMMIT: "), "commit")).alias("t")).filter("t.kind = 'GATE'").select("session", "ord", "t.gate", "t.outcome")


def _protocol(spark: SparkSession, sf_dir: str, pack: dict, kind, **columns) -> DataFrame:
    """Commits of gates by sessions of users whose events are told by kind and columns, as a stream run until all has arrived."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parquet*")
    rows = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"), kind.alias("kind"), *(c.alias(k) for k, c in columns.items()))
    folder = shared_dir(spark, "protocol")
    append_ledger(session_stream(rows, pack, intake=False), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    ledger = spark.read.schema(OUTPUT).parquet(f"{folder}/ledger").select("session", "turn", F.explode("commits").alias("commit"))
    return ledger.select("session", "turn", parse_token(F.concat(F.lit("COMMIT: "), "commit")).alias("t")).filter("t.kind = 'GATE'").select("session", "turn", "t.outcome")


@query("""WITH told AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(value) OVER w AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
first AS (SELECT user_id, min(event_id) AS event_id FROM told WHERE event_type = 'click' AND before = 'view' GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS turn, CASE WHEN value >= 5 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM first JOIN told USING (user_id, event_id)""")
def confirmed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view proposes a reading, and only a click right behind it confirms it."""
    pack = {"id": "c", "start": "VIEW", "terminals": {"DONE": ""}, "gates": [gate("VIEW", "threshold", {"PASS": "TERMINAL-DONE", "FAIL": "TERMINAL-DONE"}, ">=", {"value": 5.0})]}
    kind = F.when(F.col("event_type") == "view", "propose").when(F.col("event_type") == "click", "yes").otherwise("codes")
    return _protocol(spark, sf_dir, pack, kind, num=F.when(F.col("event_type") == "view", F.col("value")))


@query("""WITH reads AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view'), picks AS (SELECT user_id, event_id, event_id % 3 AS pick FROM events WHERE event_type = 'click' AND event_id % 3 < 2),
ready AS (SELECT r.user_id, greatest(r.first, p.first) AS turn, p.pick FROM (SELECT user_id, min(event_id) AS first FROM reads GROUP BY 1) r JOIN (SELECT user_id, min(event_id) AS first, arg_min(pick, event_id) AS pick FROM picks GROUP BY 1) p USING (user_id))
SELECT CAST(b.user_id AS VARCHAR) AS session, turn, CASE WHEN arg_max(value, r.event_id) <= CASE pick WHEN 0 THEN 4.0 ELSE 9.0 END THEN 'PASS' ELSE 'FAIL' END AS outcome FROM ready b JOIN reads r ON r.user_id = b.user_id AND r.event_id <= turn GROUP BY b.user_id, turn, pick""")
def chosen_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources disagree: a click chooses one of them (or none there is), a view reads, and the last reading counts once both are there."""
    one = gate("VIEW", "threshold", {"PASS": "TERMINAL-DONE", "FAIL": "TERMINAL-DONE"}, "<=", candidates=[{"value": 4.0}, {"value": 9.0}])
    pack = {"id": "c", "start": "VIEW", "terminals": {"DONE": ""}, "gates": [one]}
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    kind = F.when(view, "read").when(click, "choose").otherwise("codes")
    return _protocol(spark, sf_dir, pack, kind, num=F.when(view, F.col("value")).when(click, (F.col("event_id") % 3).cast("double")))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'That step is a yes/no check.' ELSE CASE WHEN event_id % 3 = 1 THEN 'That step needs V, you gave ohm.' WHEN event_id % 4 = 1 THEN 'That step is measured key on, engine off, not running.' END END AS problem
FROM events WHERE event_type <> 'signup' AND (event_type = 'purchase' OR event_id % 3 = 1 OR event_id % 4 = 1)""")
def reading_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units and states against the gates of their kind: why some cannot belong there."""
    event = F.col("event_id")
    readings = table(spark, sf_dir, "events").filter("event_type <> 'signup'").select("event_id", F.upper("event_type").alias("gate"), "value", F.when(event % 3 == 0, "v").when(event % 3 == 1, "ohm").alias("given_unit"), F.when(event % 4 == 0, "KOEO").when(event % 4 == 1, "RUNNING").alias("given_state"))
    gates = packs.gates_of(pack_rows(spark)).select(F.col("id").alias("gate"), "type", "unit", "condition")
    problem = reading_problem("type", "unit", "condition", "value", F.lit(None).cast("boolean"), "given_unit", "given_state")
    return readings.join(sessions.few(gates), "gate").select("event_id", problem.alias("problem")).filter("problem is not null")


@query("""WITH told AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'window' ELSE 'threshold' END AS kind, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN kind = 'threshold' THEN v[1] END AS value, CASE WHEN kind = 'window' THEN least(v[1], v[2]) END AS vmin, CASE WHEN kind = 'window' THEN greatest(v[1], v[2]) END AS vmax FROM told WHERE kind = 'threshold' OR len(v) >= 2""")
def captured_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's quantities, line by line, as an operator's numbers: the first two make a window, the first one a threshold."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"))))  # an order's few lines
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines["q"].alias("v"))
    spec = captured_spec(F.when(F.col("l_orderkey") % 2 == 0, "window").otherwise("threshold"), "v")
    return rows.select("l_orderkey", spec.alias("s")).filter("s is not null").select("l_orderkey", "s.*")


@query("""WITH readings AS (SELECT event_id AS reading, user_id, CASE event_id % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'ohm' END AS unit, CASE event_id % 4 WHEN 0 THEN 'KOEO' WHEN 1 THEN 'RUNNING' END AS state, CASE WHEN event_id % 2 = 0 THEN ['view', 'value'] ELSE [event_type, 'it'] END AS words, upper(event_type) AS current FROM events),
gates(gate, type, gate_unit, condition, quantity_words) AS (VALUES ('VIEW', 'threshold', 'V', 'KOEO', ['view', 'value']), ('CLICK', 'window', 'V', 'KOEO', ['click', 'value']), ('ERROR', 'threshold', 'V', 'KOEO', ['error', 'value']), ('PURCHASE', 'boolean', NULL, NULL, ['purchase', 'value'])),
scores AS (SELECT reading, gate, current, CASE WHEN type <> 'boolean' AND (unit IS NULL OR lower(unit) = lower(gate_unit)) AND (state IS NULL OR state = condition) THEN (CASE WHEN state IS NOT NULL THEN 2.0 ELSE 0.0 END) + len(list_intersect(words, quantity_words)) + (CASE WHEN gate = current THEN 0.5 ELSE 0.0 END) ELSE -1e9 END AS score FROM readings CROSS JOIN gates),
ranked AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM scores WINDOW w AS (PARTITION BY reading ORDER BY score DESC, gate DESC))
SELECT reading, gate, CAST(score AS DOUBLE) AS score FROM ranked WHERE place = 1 AND score >= 0 AND NOT (coalesce(next = score, false) AND gate <> current)""")
def reading_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gate each reading belongs to; none where two fit equally well."""
    event, kind = F.col("event_id"), F.col("event_type")
    readings = table(spark, sf_dir, "events").select(
        event.alias("reading"), F.when(event % 3 == 0, "V").when(event % 3 == 1, "ohm").alias("unit"), F.when(event % 4 == 0, "KOEO").when(event % 4 == 1, "RUNNING").alias("state"),
        F.when(event % 2 == 0, F.array(F.lit("view"), F.lit("value"))).otherwise(F.array(kind, F.lit("it"))).alias("words"), F.upper(kind).alias("current"),
    )
    gates = packs.gates_of(pack_rows(spark)).select(F.col("id").alias("gate"), "type", F.col("unit").alias("gate_unit"), "condition", F.split("quantity", " ").alias("quantity_words"))
    return merge.best_unless_tied(sessions.score_readings(readings, gates), ["reading"], "score", "gate", "current").select("reading", "gate", "score")


@query(f"""WITH found AS ({RESOLVED}), status AS (SELECT gate_key % 6 AS pack, gate_key, status, spec_ref FROM found JOIN (SELECT s_suppkey AS gate_key, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS spec_ref FROM supplier) USING (gate_key))
SELECT CAST(pack AS VARCHAR) AS pack, count(*) AS numeric_gates, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'UNVERIFIED') AS unverified, count(*) FILTER (status = 'CONFLICT') AS conflict,
coalesce(string_agg('G' || CAST(gate_key AS VARCHAR) || ' (' || coalesce(spec_ref, 'no spec_ref') || ')', '|' ORDER BY gate_key) FILTER (status <> 'RESOLVED'), '') AS needs FROM status GROUP BY 1""")
def unverified_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of suppliers as gates, with the statuses that their specs resolve to."""
    rows, asked = _specs_and_gates(spark, sf_dir)
    key = F.col("s_suppkey")
    gates = table(spark, sf_dir, "supplier").select((key % 6).cast("string").alias("pack"), key.alias("gate_key"), key.alias("ord"), F.concat(F.lit("G"), key.cast("string")).alias("gate_id"), F.when(key % 4 > 0, F.col("s_name")).alias("spec_ref"))
    return specs.unverified_report(gates, specs.resolve(asked, rows)).withColumn("needs", F.array_join("needs", "|"))

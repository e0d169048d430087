"""Queries that run as streams until all has arrived, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.gates import TOKEN_PREFIX
from quarry.operators.shared import shared_dir
from quarry.streaming.sessions import OUTPUT, append_ledger, session_stream
from quarry.streaming.turns import OUTPUT as TURN_OUTPUT
from quarry.streaming.turns import newest, run_turns, snippets
from quarry.streaming.turns import turn_stream as stream_of_turns

from .entities import table
from .gates import gate

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: One gate that a reading of 20 V or more passes.
TALK = {
    "id": "talk", "symptoms": ["reads", "^yes", "^no$", "^what", "go"], "start": "VIEW", "terminals": {"DONE": "All good."},
    "gates": [gate("VIEW", "threshold", {"PASS": "TERMINAL-DONE", "FAIL": "TERMINAL-DONE"}, ">=", {"value": 20.0}) | {"title": "Voltage", "quantity": "battery voltage"}],
}
#: Of each turn its session's part (parts begin behind a silence), the turn before it there, and the turn that ends the flow.
TOLD = """gaps AS (SELECT *, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
parts AS (SELECT *, count(*) FILTER (gap > {silence}) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM gaps),
pairs AS (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS told FROM parts WINDOW w AS (PARTITION BY user_id, part ORDER BY event_id)),
ends AS (SELECT user_id, part, min(event_id) AS done, arg_min(told, event_id) AS reading FROM pairs WHERE event_type = 'click' AND before = 'view' GROUP BY 1, 2),
turns AS (SELECT p.*, done, reading, done IS NULL OR event_id <= done AS open FROM pairs p LEFT JOIN ends USING (user_id, part))"""
NEVER = 1 << 60


def _turns(spark: SparkSession, sf_dir: str, silence: int | None) -> DataFrame:
    """The events of turn_stream: a view tells a reading, a click says yes, a purchase no, an error asks for a supplier, a signup goes on."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parquet*")
    kind, asked = F.col("event_type"), F.concat(F.lit("what is sup"), (F.col("event_id") % 10 + 1).cast("string"), F.lit("?"))
    text = F.when(kind == "view", F.concat(F.lit("it reads "), F.floor("value").cast("string"), F.lit(" V"))).when(kind == "click", "yes").when(kind == "purchase", "no").when(kind == "error", asked).otherwise("go on")
    folder = shared_dir(spark, "turns")
    rows = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"), text.alias("text"))
    run_turns(stream_of_turns(rows, [TALK], silence), f"{folder}/events", f"{folder}/state")
    return spark.read.schema(TURN_OUTPUT).parquet(f"{folder}/events")


@query(f"""WITH {TOLD.format(silence=NEVER)},
notes AS (SELECT s_suppkey, 'sup' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey = 1 THEN ' voltage ' ELSE ' ' END || array_to_string(list_transform(range(60), lambda i: 'note' || CAST(i AS VARCHAR)), ' ') AS line FROM supplier),
found AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 + event_id % 10 WHEN event_type IN ('signup') OR NOT (event_type = 'view' OR coalesce(before = 'view', false)) OR (coalesce(before = 'view', false) AND event_type <> 'view') THEN 1 END AS asks FROM turns)
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS turn,
  CASE WHEN event_type = 'error' THEN 'CHAT-Q' WHEN open AND event_type = 'view' THEN 'CHAT-CONFIRM' WHEN open AND before = 'view' AND event_type IN ('click', 'purchase') THEN 'CHAT-CONFIRM' ELSE 'TURN' END AS context,
  CASE WHEN event_id = done THEN '{TOKEN_PREFIX}GATE-VIEW-' || CASE WHEN floor(reading) >= 20 THEN 'PASS' ELSE 'FAIL' END || ' {TOKEN_PREFIX}TERMINAL-DONE' ELSE '' END AS commits,
  CASE WHEN event_id >= done THEN 'TERMINAL' ELSE 'NEED_READING' END AS status,
  substr(line, 1, CASE WHEN event_type = 'error' THEN 240 ELSE 200 END) AS snippet
FROM found LEFT JOIN notes ON s_suppkey = CASE WHEN event_type = 'error' THEN asks WHEN open AND event_id IS DISTINCT FROM done AND event_type <> 'view' THEN 1 END""")
def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of all users as a stream of free text: contexts, commits, statuses, and what the notes on suppliers say about it."""
    told = _turns(spark, sf_dir, None)
    key = F.col("s_suppkey")
    text = F.concat(F.lit("sup"), key.cast("string"), F.when(key == 1, "\tvoltage  ").otherwise(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("note"), i.cast("string"))), " \n"))
    notes = table(spark, sf_dir, "supplier").select(key, text.alias("text"))
    found = snippets(told, notes, "s_suppkey", "text", 1).select("session", "turn", "snippet")
    rows = told.join(found, ["session", "turn"], "left")
    return rows.select("session", "turn", "context", F.array_join("commits", " ").alias("commits"), "status", "snippet")


SILENCE = 150


@query(f"""WITH {TOLD.format(silence=SILENCE)}, last AS (SELECT user_id FROM events GROUP BY 1 ORDER BY max(event_id) DESC, CAST(user_id AS VARCHAR) LIMIT 200)
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS turn, CASE WHEN event_id >= done THEN 'TERMINAL' ELSE 'NEED_READING' END AS status, event_id = done AS ended FROM turns SEMI JOIN last USING (user_id)""".replace("event_id = done AS", "coalesce(event_id = done, false) AS"))
def ended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 sessions that were turned to last; each begins anew behind a silence, so that a user may end more than one."""
    return newest(_turns(spark, sf_dir, SILENCE), 200).select("session", "turn", "status", (F.size("commits") > 0).alias("ended"))


def _several() -> dict:
    """Two gates of numbers, the second without limits, and one of yes or no."""
    return {
        "id": "s", "start": "A", "terminals": {"OK": ""},
        "gates": [gate("A", "threshold", {"PASS": "B", "FAIL": "B"}, ">=", {"value": 50.0}), gate("B", "window", {"LOW": "C", "PASS": "C", "HIGH": "C"}), gate("C", "boolean", {"YES": "TERMINAL-OK", "NO": "TERMINAL-OK"})],
    }


@query("""WITH told AS (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS a, lag(event_id) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
yes AS (SELECT * FROM told WHERE event_type = 'click'),
begins AS (SELECT user_id, min(event_id) AS first FROM yes WHERE before = 'view' GROUP BY 1),
ends AS (SELECT user_id, min(event_id) AS done FROM yes JOIN begins USING (user_id) WHERE before = 'purchase' AND event_id > first GROUP BY 1),
pairs AS (SELECT y.*, first, done FROM yes y JOIN begins USING (user_id) LEFT JOIN ends USING (user_id) WHERE before = 'view' AND (done IS NULL OR event_id < done)),
last AS (SELECT user_id, any_value(done) AS done, arg_max(was, event_id) AS was FROM pairs WHERE done IS NOT NULL GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS turn, CASE WHEN event_id = first THEN 'PENDING-B PENDING-C GATE-A-' || CASE WHEN a >= 50 THEN 'PASS' ELSE 'FAIL' END ELSE 'PENDING-C' END AS commits, 'NEED_SPEC' AS status FROM pairs
UNION ALL SELECT CAST(user_id AS VARCHAR), done, 'GATE-B-' || CASE WHEN was % 10 < 2 THEN 'LOW' WHEN was % 10 > 5 THEN 'HIGH' ELSE 'PASS' END || ' GATE-C-' || CASE WHEN was % 3 = 0 THEN 'YES' ELSE 'NO' END || ' TERMINAL-OK', 'TERMINAL' FROM last""")
def compound_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view proposes readings for three gates at once and codes, a purchase the limits that one of them lacks; a click right behind says yes to all of it."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parquet*")
    kind, event = F.col("event_type"), F.col("event_id")
    none = {"n": F.lit(None).cast("double"), "f": F.lit(None).cast("boolean"), "s": F.lit(None).cast("string")}

    def reading(name: str, num: Column = none["n"], flag: Column = none["f"]) -> Column:
        return F.struct(F.lit(name).alias("gate"), num.alias("num"), flag.alias("flag"), none["s"].alias("unit"), none["s"].alias("state"))

    told = F.array(reading("B", (event % 10).cast("double")), reading("C", flag=event % 3 == 0), reading("A", F.col("value")))
    rows = events.select(
        F.col("user_id").cast("string").alias("session"), event.alias("turn"), F.when(kind.isin("view", "purchase"), "propose").when(kind == "click", "yes").otherwise("codes").alias("kind"),
        F.when(kind == "view", told).alias("readings"), F.when(kind == "view", "p0101 u0100").alias("text"), F.when(kind == "purchase", 5.0).alias("high"), F.when(kind == "purchase", 2.0).alias("low"),
    )
    folder = shared_dir(spark, "compound")
    append_ledger(session_stream(rows, _several(), intake=False), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    commits = F.replace(F.array_join("commits", " "), F.lit(TOKEN_PREFIX), F.lit(""))
    return spark.read.schema(OUTPUT).parquet(f"{folder}/ledger").filter(F.size("commits") > 0).select("session", "turn", commits.alias("commits"), "status")

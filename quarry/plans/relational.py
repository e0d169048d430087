"""Queries for pools, rules, quality, merges, exports and job planning, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.matching import model_matches, parse_subject
from quarry.functions.text import general_number, slug, spec_key
from quarry.operators import jobs, merge, pool, quality
from quarry.operators.shared import written
from quarry.sources.seed import as_tables, seed_vehicles
from quarry.sources.sinks import flat_rows

from .entities import ALL, ORDER_MEMBERS, VEHICLES, clusters, line_tasks, membership, order_members, table, vehicles

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


POOL = "WITH " + ALL + """,
found AS (SELECT id FROM vehicles WHERE {where}),
shared AS (SELECT DISTINCT cluster_id FROM membership WHERE vehicle_id IN (SELECT id FROM found)),
peers AS (
  SELECT {bucket} AS bucket, cluster_id, make, model, styles, year_start, year_end, confidence, coalesce(note, '') AS note, coalesce(label, '') AS label,
    row_number() OVER (PARTITION BY {key} ORDER BY type, cluster_id, lower(make), lower(model), year_start, id) AS place
  FROM membership JOIN vehicles ON id = vehicle_id JOIN clusters USING (cluster_id)
  WHERE cluster_id IN (SELECT cluster_id FROM shared) AND vehicle_id NOT IN (SELECT id FROM found))
SELECT bucket, cluster_id, make, model, styles, year_start, year_end, confidence, note, label FROM peers WHERE place = 1"""


def pool_sql(where: str, bucket: str, key: str) -> str:
    return POOL.replace("{where}", where).replace("{bucket}", bucket).replace("{key}", key)


BUCKET = "CASE WHEN type = 'structural' THEN 'structural' ELSE 'engine_family' END"


@query(pool_sql("lower(make) = 'brand#2' AND 1998 BETWEEN year_start AND year_end AND (contains(lower(model), 'ring') OR contains('ring', lower(model)))", BUCKET, f"{BUCKET}, lower(make), lower(model), lower(coalesce(note, ''))"))
def donor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.donor_pool(vehicles(spark, sf_dir), clusters(spark, sf_dir), membership(spark, sf_dir), "brand#2", "Ring", 1998)


@query(pool_sql("lower(make) = 'brand#7' AND 1999 BETWEEN year_start AND year_end AND (contains(lower(model), 'hot bolt') OR contains('hot bolt', lower(model)))", "type", "type, make, model, coalesce(note, '')"))
def donor_pool_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.donor_pool(vehicles(spark, sf_dir), clusters(spark, sf_dir), membership(spark, sf_dir), "Brand#7", "hot_bolt", 1999, separators=True)


@query("""WITH rows AS (
  SELECT p_partkey, CAST(100 + p_size AS VARCHAR) || ',' || CAST(300 + p_size AS VARCHAR) || '/' || p_name AS model FROM part
  UNION ALL SELECT -1 - p_partkey, CAST(p_size % 10 AS VARCHAR) || '-series' FROM part),
asked(asked) AS (VALUES ('328i'), ('RING'), ('110'), ('x'), ('')),
pairs AS (SELECT p_partkey, asked, model, lower(trim(asked)) AS a, lower(trim(model)) AS m, regexp_extract(lower(asked), '([0-9]{3})', 1) AS badge FROM rows CROSS JOIN asked)
SELECT asked, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM pairs
WHERE a <> '' AND m <> '' AND (contains(m, a) OR contains(a, m) OR (badge <> '' AND (len(list_filter(regexp_split_to_array(m, '[,/]'), lambda t: starts_with(trim(t), badge))) > 0 OR m = badge[1] || '-series')))
GROUP BY asked""")
def fuzzy_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    model = F.concat((100 + F.col("p_size")).cast("string"), F.lit(","), (300 + F.col("p_size")).cast("string"), F.lit("/"), "p_name")
    rows = part.select("p_partkey", model.alias("model")).union(part.select(-1 - F.col("p_partkey"), F.concat((F.col("p_size") % 10).cast("string"), F.lit("-series"))))
    pairs = rows.withColumn("asked", F.explode(F.array(*map(F.lit, ("328i", "RING", "110", "x", "")))))
    return pairs.filter(model_matches("asked", "model")).groupBy("asked").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("ids"))


@query("""SELECT o_orderkey, CAST(regexp_extract(q, '^([0-9]{4})\\s+(\\S+)\\s+(.+)$', 1) AS INTEGER) AS year, regexp_extract(q, '^([0-9]{4})\\s+(\\S+)\\s+(.+)$', 2) AS make, regexp_extract(q, '^([0-9]{4})\\s+(\\S+)\\s+(.+)$', 3) AS model
FROM (SELECT o_orderkey, trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '  ' || CAST(year(o_orderdate) AS VARCHAR) || '  ' || o_orderpriority || ' ' || o_orderstatus END) AS q FROM orders)
WHERE regexp_matches(q, '^([0-9]{4})\\s+(\\S+)\\s+(.+)$')""")
def subject_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("  "), F.year("o_orderdate").cast("string"), F.lit("  "), "o_orderpriority", F.lit(" "), "o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", parse_subject(text).alias("s")).filter("s is not null")
    return rows.select("o_orderkey", "s.year", "s.make", "s.model")


RULES = [(1, "5", "Brand#3", "RED%", 1996, 1997, "a"), (2, "7", "Brand#4", "% bolt", 1999, 2000, "b"), (3, "8", "Brand#9", "none%", 1990, 2010, "c"), (4, "x1", "Brand#5", "%ring%", 1994, 1995, "d"), (5, "11", "Brand#6", "%", 1980, 1990, "e")]
RULE_VALUES = "rules(rule_id, cluster_id, make, model_like, year_from, year_to, note) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', '{d}', {e}, {f}, '{g}')" for a, b, c, d, e, f, g in RULES) + ")"
LINKS = "links AS (SELECT rule_id, id AS vehicle_id, cluster_id, note FROM rules JOIN vehicles v ON v.make = rules.make AND v.model ILIKE model_like AND year_start <= year_to AND year_end >= year_from)"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id int, cluster_id string, make string, model_like string, year_from int, year_to int, note string")


@query(f"WITH {VEHICLES}, {RULE_VALUES}, {LINKS} SELECT rule_id, vehicle_id, cluster_id, note FROM links")
def interval_overlap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.rule_links(vehicles(spark, sf_dir), rules(spark))


@query(f"WITH {VEHICLES}, {RULE_VALUES}, {LINKS} SELECT rule_id, cluster_id, make, model_like FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM links)")
def empty_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules(spark)
    return pool.empty_rules(own, pool.rule_links(vehicles(spark, sf_dir), own)).select("rule_id", "cluster_id", "make", "model_like")


@query(f"WITH {ALL}, {RULE_VALUES} SELECT rule_id, cluster_id FROM rules WHERE cluster_id NOT IN (SELECT cluster_id FROM clusters)")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.unknown_references(rules(spark).select("rule_id", "cluster_id"), clusters(spark, sf_dir))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_partkey").alias("vehicle_id"))
    return quality.duplicate_tuples(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), ["l_partkey", "l_suppkey"])


CHECKS = f"""WITH {VEHICLES}, {ORDER_MEMBERS},
own AS (SELECT m.cluster_id, m.scope, m.confidence, v.*, list_distinct(list_filter(list_transform(string_split(drive, ','), lambda x: trim(x)), lambda x: x <> '')) AS drives FROM order_members m JOIN vehicles v ON id = vehicle_id),
facts AS (SELECT cluster_id, count(*) AS members, count(DISTINCT nullif(construction, '')) AS kinds, count(*) FILTER (len(drives) > 0) AS driven,
  max(CAST(wheelbase AS DOUBLE)) - min(CAST(wheelbase AS DOUBLE)) AS spread, max(year_start) > min(year_end) AS apart FROM own GROUP BY cluster_id),
shared AS (SELECT cluster_id, max(n) AS most FROM (SELECT cluster_id, drive1, count(*) AS n FROM (SELECT cluster_id, unnest(drives) AS drive1 FROM own) GROUP BY 1, 2) GROUP BY 1),
checks AS (SELECT cluster_id, members, concat_ws('; ', CASE WHEN kinds > 1 THEN 'construction mismatch' END, CASE WHEN driven > 0 AND most < driven THEN 'no shared drive-wheel intersection' END,
  CASE WHEN spread > 1.0 THEN 'wheelbase spread exceeds 1.0 in' END, CASE WHEN apart THEN 'no production-year overlap' END) AS reasons
  FROM facts LEFT JOIN shared USING (cluster_id) WHERE members > 1)"""


def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = order_members(spark, sf_dir)
    return quality.consistency(members.join(vehicles(spark, sf_dir), F.col("vehicle_id") == F.col("id")))


@query(f"{CHECKS} SELECT cluster_id, members, reasons FROM checks")
def cluster_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_checks(spark, sf_dir)


@query(f"""{CHECKS}, flags AS (SELECT cluster_id FROM checks WHERE reasons LIKE '%year%'),
reverted AS (SELECT vehicle_id, cluster_id, CASE WHEN cluster_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') AND confidence = 'edc-flagged' THEN 'edc' ELSE confidence END AS confidence FROM order_members)
SELECT vehicle_id, cluster_id, CASE WHEN cluster_id IN (SELECT cluster_id FROM flags) AND confidence = 'edc' THEN 'edc-flagged' ELSE confidence END AS confidence FROM reverted""")
def flag_revert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = order_members(spark, sf_dir)
    flags = order_checks(spark, sf_dir).filter("reasons like '%year%'")
    earlier = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("cluster_id"))
    return quality.apply_flags(members, flags, earlier).select("vehicle_id", "cluster_id", "confidence")


@query("SELECT event_type AS method, CAST(user_id AS VARCHAR) AS cluster_id, CASE WHEN value > 10 THEN 'flag' ELSE 'ok' END AS result, count(*) AS n FROM events GROUP BY 1, 2, 3")
def verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("cluster_id"), F.when(F.col("value") > 10, "flag").otherwise("ok").alias("result"))
    return quality.verdict_report(log)


@query(f"""WITH {ALL} SELECT count(*) AS edges, count(DISTINCT vehicle_id) AS linked, count(DISTINCT cluster_id) AS clusters, CAST(sum(CASE WHEN scope = 'engine-loop' THEN 1 ELSE 0 END) AS BIGINT) AS engine_edges,
min(year_start) AS first_year, max(year_end) AS last_year, round(CAST(count(DISTINCT vehicle_id) AS DOUBLE) / (SELECT count(*) FROM part), 6) AS coverage FROM membership JOIN vehicles ON id = vehicle_id""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = membership(spark, sf_dir).join(vehicles(spark, sf_dir), F.col("id") == F.col("vehicle_id"))
    facts = rows.agg(F.count("*").alias("edges"), F.count_distinct("vehicle_id").alias("linked"), F.count_distinct("cluster_id").alias("clusters"), F.sum(F.when(F.col("scope") == "engine-loop", 1).otherwise(0)).alias("engine_edges"), F.min("year_start").alias("first_year"), F.max("year_end").alias("last_year"))
    total = table(spark, sf_dir, "part").agg(F.count("*").alias("total"))  # one row each
    return facts.join(F.broadcast(total)).select("edges", "linked", "clusters", "engine_edges", "first_year", "last_year", F.round(F.col("linked") / F.col("total"), 6).alias("coverage"))


#: The seed's rules once more: pairs of vehicles, of which the first 110 clash in one of four ways, and single ones.
SEED = """WITH pairs AS (SELECT k, side, CASE WHEN k <= 110 THEN k % 4 ELSE 9 END AS mode, 1994 + k % 18 AS base FROM range(1, 908) a(k), range(2) b(side)),
cars AS (SELECT k AS cluster, CASE WHEN mode = 0 AND side = 0 THEN 'f' ELSE 'u' END AS construction, CASE mode WHEN 0 THEN 'f' WHEN 1 THEN CASE side WHEN 1 THEN 'r' ELSE 'f' END WHEN 2 THEN 'a' ELSE 'r,4' END AS drive,
  CASE mode WHEN 0 THEN 106.0 WHEN 1 THEN 108.0 WHEN 2 THEN 104.0 + 2.2 * side WHEN 3 THEN 110.0 + 0.4 * side ELSE 109.0 + 0.6 * side END AS wheelbase, base + CASE WHEN mode = 3 THEN 4 * side WHEN mode = 9 THEN side ELSE 0 END AS y0, base + CASE WHEN mode = 3 THEN 2 + 5 * side WHEN mode = 9 THEN 6 + side ELSE 6 END AS y1 FROM pairs
  UNION ALL SELECT 10000 + n, 'u', 'r', 111.0, 2000, 2001 FROM range(62) c(n)),
checks AS (SELECT cluster, count(*) AS members, count(DISTINCT construction) > 1 AS c, list_has_any(string_split(min(drive), ','), string_split(max(drive), ',')) AS d, max(wheelbase) - min(wheelbase) > 1 AS w, max(y0) > min(y1) AS y FROM cars GROUP BY 1),
told AS (SELECT concat_ws('; ', CASE WHEN c THEN 'construction mismatch' END, CASE WHEN NOT d THEN 'no shared drive-wheel intersection' END, CASE WHEN w THEN 'wheelbase spread exceeds 1.0 in' END, CASE WHEN y THEN 'no production-year overlap' END) AS reasons FROM checks WHERE members > 1)
SELECT (SELECT CAST(count(DISTINCT cluster) AS INTEGER) FROM cars) AS clusters, (SELECT CAST(count(*) AS INTEGER) FROM cars) AS vehicles, reasons, count(*) AS n FROM told WHERE reasons <> '' GROUP BY reasons"""


@query(SEED)
def seed_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated seed table: 969 clusters of 1876 vehicles, 110 of them inconsistent by rule."""
    cars, groups, edges = as_tables(seed_vehicles(spark))
    flags = quality.flagged(quality.consistency(edges.join(cars, F.col("vehicle_id") == F.col("id"))))
    totals = groups.agg(F.count("*").cast("int").alias("clusters")).join(cars.agg(F.count("*").cast("int").alias("vehicles")))
    return flags.groupBy("reasons").agg(F.count("*").alias("n")).join(F.broadcast(totals)).select("clusters", "vehicles", "reasons", "n")


@query("""WITH own AS (SELECT p_brand AS make, count(*) AS raw, count(*) FILTER (p_size % 50 = 0) AS skipped, count(DISTINCT p_name || p_type) AS n FROM part GROUP BY 1)
SELECT make, raw, skipped, n AS "unique", round(skipped / raw, 6) AS skipped_ratio, CASE WHEN skipped / raw > 0.03 THEN 'too many rows skipped' WHEN n < 20 THEN 'too few vehicles' END AS problem FROM own""")
def parse_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand as a parsed source: its share of skipped rows and its number of vehicles against limits."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("make")).agg(F.count("*").alias("raw"), F.count_if(F.col("p_size") % 50 == 0).alias("skipped"), F.count_distinct(F.concat("p_name", "p_type")).alias("unique"))
    return quality.parse_gate(counts, 0.03, 20).withColumn("skipped_ratio", F.round("skipped_ratio", 6))


@query(f"""WITH {ALL}, curated AS (SELECT id AS vehicle_id, CAST(1 + id % 7 AS VARCHAR) AS cluster_id, 'platform' AS scope, 'curated' AS confidence, make AS note FROM vehicles WHERE id % 3 = 0)
SELECT vehicle_id, cluster_id, scope, confidence, note FROM membership WHERE confidence <> 'curated' UNION ALL SELECT * FROM curated""")
def curated_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated tier of edges, laid over the others twice with the same result."""
    key = F.col("id")
    new = vehicles(spark, sf_dir).filter(key % 3 == 0).select(key.alias("vehicle_id"), (1 + key % 7).cast("string").alias("cluster_id"), F.lit("platform").alias("scope"), F.col("make").alias("note"))
    edges = membership(spark, sf_dir).select("vehicle_id", "cluster_id", "scope", "confidence", "note")
    once, _ = pool.apply_curated(edges, new)
    return pool.apply_curated(once, new)[0]


@query(f"WITH {ALL} SELECT id, make, model, year_start, year_end, cluster_id, type, scope, confidence, note, label FROM membership JOIN clusters USING (cluster_id) JOIN vehicles ON id = vehicle_id")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_rows(vehicles(spark, sf_dir), clusters(spark, sf_dir), membership(spark, sf_dir))
    return rows.select("id", "make", "model", "year_start", "year_end", "cluster_id", "type", "scope", "confidence", "note", "label")


@query(f"WITH {ALL}, few AS (SELECT * FROM membership WHERE scope = 'engine-loop' AND note = 'R') SELECT id, make, model, year_start, cluster_id, coalesce(scope, '') AS scope, coalesce(note, '') AS note FROM vehicles LEFT JOIN few ON id = vehicle_id")
def export_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_rows(vehicles(spark, sf_dir), clusters(spark, sf_dir), membership(spark, sf_dir).filter("scope = 'engine-loop' and note = 'R'"), keep_alone=True)
    return rows.select("id", "make", "model", "year_start", "cluster_id", F.coalesce("scope", F.lit("")).alias("scope"), "note")


NEW = "SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS v FROM lineitem"
OLD = "SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_acctbal > 0"


def _upsert_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("v"))
    old = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return old, new


@query(f"SELECT k, v FROM ({OLD}) UNION ALL SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY ord, v) AS place FROM ({NEW}) WHERE k NOT IN (SELECT k FROM ({OLD}))) WHERE place = 1")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _upsert_tables(spark, sf_dir)
    return merge.insert_or_ignore(old, new, ["k"], ["ord", "v"])


@query(f"WITH new AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY ord DESC, v DESC) AS place FROM ({NEW}) WHERE v = 'R') WHERE place = 1) SELECT k, v FROM new UNION ALL SELECT k, v FROM ({OLD}) WHERE k NOT IN (SELECT k FROM new)")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _upsert_tables(spark, sf_dir)
    return merge.insert_or_replace(old, new.filter("v = 'R'"), ["k"], [F.desc("ord"), F.desc("v")])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -c_custkey - 1, 'P', c_acctbal FROM customer")
def replace_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("o_orderkey"), F.lit("P").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    return merge.replace_tier(old, new, F.col("o_orderstatus") == "P")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, 900000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by date; the other columns stay with their rows."""
    return merge.numbered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], first=900_001).select("o_orderkey", "o_orderstatus", "o_totalprice", "id")


@query("""WITH placed AS (SELECT o_orderpriority AS scope, CAST(o_custkey AS VARCHAR) AS cluster_id, o_orderkey AS job_ord, row_number() OVER (ORDER BY o_orderpriority, CAST(o_custkey AS VARCHAR), o_orderkey) - 1 AS place, count(*) OVER () // 97 AS step FROM orders)
SELECT scope, cluster_id, job_ord FROM placed WHERE place % step = 0 AND place < step * 97""")
def spread_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial run's targets: 97 of all, spread evenly over their order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_custkey").cast("string").alias("cluster_id"), F.col("o_orderkey").alias("job_ord"))
    return jobs.spread_sample(rows, 97)


@query("""WITH tagged AS (SELECT p_partkey AS id, trim(t) AS tag FROM (SELECT p_partkey, unnest(string_split(p_brand || ':' || p_type || '; ;' || p_name || ';', ';')) AS t FROM part))
SELECT id AS vehicle_id, trim(string_split(tag, ':')[1]) AS cluster_id, 'platform' AS scope, CASE WHEN contains(tag, ':') THEN trim(substr(tag, instr(tag, ':') + 1)) ELSE '' END AS note FROM tagged WHERE tag <> ''""")
def tag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(":"), "p_type", F.lit("; ;"), "p_name", F.lit(";")).alias("platform"))
    return pool.tag_members(rows, "platform", "platform")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN props ELSE NULL END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS make FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("props")).otherwise("").alias("make"))
    return merge.carry_forward(rows, "make", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "make")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place, greatest(1, count(*) OVER (PARTITION BY o_orderpriority) // 50) AS step FROM orders)
WHERE place % step = 0 AND place // step < 50""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.stride_sample(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 50)


@query("""WITH firsts AS (SELECT l_suppkey, p_name AS label, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
few AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_at, label) AS place FROM firsts)
SELECT l_suppkey, string_agg(label, '|' ORDER BY place) AS labels FROM few WHERE place <= 8 GROUP BY 1""")
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", F.col("p_name").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return merge.first_labels(rows, ["l_suppkey"], "label", "at").select("l_suppkey", F.array_join("labels", "|").alias("labels"))


@query("""WITH scores AS (SELECT user_id, event_type AS gate, CAST(count(*) % 7 AS DOUBLE) - 1 AS score FROM events GROUP BY 1, 2),
ranked AS (SELECT user_id, gate, score, row_number() OVER w AS place, lead(score) OVER w AS next FROM scores WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, gate DESC))
SELECT user_id, gate, score FROM ranked WHERE place = 1 AND score >= 0 AND NOT (coalesce(next = score, false) AND gate <> 'view')""")
def ambiguous_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("gate")).agg(((F.count("*") % 7).cast("double") - 1).alias("score")).withColumn("current", F.lit("view"))
    return merge.best_unless_tied(scores, ["user_id"], "score", "gate", "current").select("user_id", "gate", "score")


JOBS = [("structural", "Front brake pads", 0), ("structural", "Cabin air filter", 1), ("engine-loop", "Engine oil", 0), ("engine-loop", "Spark plugs", 1), ("engine-loop", "Water pump", 2)]
JOB_VALUES = "jobs(scope, job, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in JOBS) + ")"
TARGETS = f"""WITH {ALL}, {JOB_VALUES},
flat AS (SELECT scope, cluster_id, vehicle_id AS ord, CAST(year_start AS VARCHAR) || '-' || CAST(year_end AS VARCHAR) || ' ' || make || ' ' || model || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END AS label FROM membership JOIN vehicles ON id = vehicle_id),
firsts AS (SELECT scope, cluster_id, label, min(ord) AS first_at FROM flat GROUP BY 1, 2, 3),
few AS (SELECT *, row_number() OVER (PARTITION BY scope, cluster_id ORDER BY first_at, label) AS place FROM firsts),
grouped AS (SELECT scope, cluster_id, string_agg(label, '|' ORDER BY place) AS labels FROM few WHERE place <= 8 GROUP BY 1, 2),
targets AS (SELECT scope, cluster_id, job, labels, substr(trim(regexp_replace(lower(cluster_id), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) || '_' || substr(sha256(cluster_id || '|' || job), 1, 10) AS custom_id FROM grouped JOIN jobs USING (scope))"""
PENDING = """done AS (SELECT custom_id FROM targets WHERE CAST(cluster_id AS BIGINT) % 5 = 0), requests AS (SELECT custom_id, CAST(cluster_id AS BIGINT) % 4 AS batch FROM targets WHERE CAST(cluster_id AS BIGINT) % 3 = 1),
pending AS (SELECT * FROM targets WHERE custom_id NOT IN (SELECT custom_id FROM done UNION ALL SELECT custom_id FROM requests WHERE batch <> 0))"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = membership(spark, sf_dir).join(vehicles(spark, sf_dir), F.col("id") == F.col("vehicle_id")).withColumn("ord", F.col("vehicle_id"))
    return jobs.targets(flat, spark.createDataFrame(JOBS, "scope string, job string, ord int"), ["structural", "engine-loop"], tasks=line_tasks(spark, sf_dir))


def _pending(rows: DataFrame) -> DataFrame:
    rows = written(rows, "targets")  # they are asked three times
    number = F.col("cluster_id").cast("long")
    done = rows.filter(number % 5 == 0).select("custom_id", F.lit("ok").alias("status"))
    requests = rows.filter(number % 3 == 1).select("custom_id", (number % 4).alias("batch_id"))
    batches = rows.sparkSession.range(4).select(F.col("id").alias("batch_id"), F.when(F.col("id") == 0, "ended").otherwise("open").alias("status"))
    return jobs.pending(rows, done, requests, batches)


@query(f"{TARGETS} SELECT scope, cluster_id, job, labels, custom_id FROM targets")
def cross_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("scope", "cluster_id", "job", F.array_join("labels", "|").alias("labels"), "custom_id")


@query(f"{TARGETS}, {PENDING} SELECT scope, cluster_id, job, custom_id FROM pending")
def pending_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(_targets(spark, sf_dir)).select("scope", "cluster_id", "job", "custom_id")


@query(f"""{TARGETS}, {PENDING} SELECT requests, clusters, tokens_in, round((tokens_in * 2.0 + requests * 3500 * 10.0) / 1000000 / 2, 2) AS est_cost, round((tokens_in * 2.0 + requests * 8000 * 10.0) / 1000000 / 2, 2) AS worst_cost
FROM (SELECT count(*) AS requests, count(DISTINCT scope || ' ' || cluster_id) AS clusters, CAST(sum(length(job || ': ' || labels) // 4) AS BIGINT) AS tokens_in FROM pending)""")
def cost_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.plan(_pending(_targets(spark, sf_dir)), F.concat("job", F.lit(": "), F.array_join("labels", "|")), 2.0, 10.0)


@query("""SELECT batch_id, status, count(*) AS n, round(sum((i * 2.0 + o * 10.0) / 1000000 / 2), 4) AS cost_usd FROM (
SELECT user_id % 5 AS batch_id, CASE WHEN event_type = 'error' THEN 'errored' WHEN event_type = 'click' THEN 'max_tokens' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 0 ELSE 400 END AS i, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 3000 END AS o FROM events) GROUP BY 1, 2""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("custom_id", F.col("event_id").cast("string"))
    kind = F.when(F.col("event_type") == "error", "errored").otherwise("succeeded")
    stop = F.when(F.col("event_type") == "click", "max_tokens").otherwise("end_turn")
    message = F.when(F.col("event_type") != "error", F.struct(stop.alias("stop_reason"), F.lit("").alias("text"), F.lit(400).cast("long").alias("input_tokens"), (F.col("event_id") % 3000).alias("output_tokens")))
    results = events.select("custom_id", kind.alias("type"), message.alias("message"))
    requests = events.select("custom_id", (F.col("user_id") % 5).alias("batch_id"), F.lit("").alias("cluster_id"), F.lit("").alias("scope"), F.lit("").alias("job"))
    return jobs.batch_summary(jobs.result_rows(results, requests, 2.0, 10.0))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
CASE WHEN p_size % 3 = 0 THEN '' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.' END || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_' || lower(p_type) END AS spec_key FROM part""")
def slug_spec_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    family, state = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), spec_key(family, "p_name", state).alias("spec_key"))


@query("SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice / 7.013) AS a, printf('%g', l_discount / 10000) AS b, printf('%g', l_quantity) AS c FROM lineitem")
def general_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", general_number(F.col("l_extendedprice") / 7.013).alias("a"), general_number(F.col("l_discount") / 10000).alias("b"), general_number("l_quantity").alias("c"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'changed' ELSE 'unchanged' END AS status, sha256(text) AS sha256 FROM documents")
def doc_hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.sources.documents import changed

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    known = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 1, "!").otherwise("")), 256).alias("sha256"))
    return changed(docs, known).select(F.col("path").alias("doc_id"), "status", "sha256")


"""Queries of the SQL surface, collations, open JSON, tiers, batches, scans and final orders, with the same results in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import collate, extraction, sql
from quarry.operators import jobs, merge, packs, submission
from quarry.operators.shared import shared_dir, written
from quarry.sources.documents import Knowledge, ingest, no_knowledge, with_reasons
from quarry.sources.sinks import flat_rows, write_text_files

from . import outputs, relational, texts
from .entities import ALL, clusters, membership, table, vehicles
from .gates import PACK

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


every = relational.ORACLE_SQL | outputs.ORACLE_SQL


@query(every["slug_spec_key"])
def sql_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug_spec_key in spark.sql alone."""
    sql.register(spark)
    rows = "SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS family, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS state FROM {part}"
    return spark.sql(f"SELECT p_partkey, slug(concat_ws(' ', p_name, p_brand)) AS slug, spec_key(family, p_name, state) AS spec_key FROM ({rows})", part=table(spark, sf_dir, "part"))


@query(texts.ORACLE_SQL["chunk_documents"])
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_documents in spark.sql alone, by the table function."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, place AS ord, c.text FROM {documents} d, LATERAL chunk_text(d.text) c", documents=table(spark, sf_dir, "documents"))


#: Spellings, the word that they are without case, and without accents too.
SPELLINGS = {
    "Straße": ("strasse", "strasse"), "STRASSE": ("strasse", "strasse"), "strasse": ("strasse", "strasse"), "École": ("école", "ecole"), "école": ("école", "ecole"), "ecole": ("ecole", "ecole"),
    "İstanbul": ("i̇stanbul", "istanbul"), "istanbul": ("istanbul", "istanbul"), "ISTANBUL": ("istanbul", "istanbul"), "Σίσυφος": ("σίσυφοσ", "σισυφοσ"), "ΣΊΣΥΦΟΣ": ("σίσυφοσ", "σισυφοσ"), "Zug": ("zug", "zug"),
}
_values = ", ".join(f"({i}, '{s}', '{a}', '{b}')" for i, (s, (a, b)) in enumerate(SPELLINGS.items()))
#: Their places in the order of German readers.
GERMAN = ["ecole", "école", "École", "istanbul", "ISTANBUL", "İstanbul", "strasse", "STRASSE", "Straße", "Zug", "Σίσυφος", "ΣΊΣΥΦΟΣ"]


@query(f"""WITH spelled(n, word, folded, plain) AS (VALUES {_values}), places(word, place) AS (VALUES {", ".join(f"('{w}', {i})" for i, w in enumerate(GERMAN))}),
rows AS (SELECT c_custkey, word, folded, plain FROM customer JOIN spelled ON n = c_custkey % {len(SPELLINGS)}),
counts AS (SELECT folded, count(*) AS n_folded FROM rows GROUP BY 1), plains AS (SELECT plain, count(*) AS n_plain FROM rows GROUP BY 1)
SELECT c_custkey, word, n_folded, n_plain, folded = 'strasse' AS is_street, CAST(place AS INTEGER) AS place FROM rows JOIN counts USING (folded) JOIN plains USING (plain) JOIN places USING (word)""")
def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, grouping and order by collations: ß and ss, dotted and plain i, accents, final sigmas."""
    words = F.array(*map(F.lit, SPELLINGS))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(words, (F.col("c_custkey") % len(SPELLINGS)).cast("int")).alias("word"))
    folded = rows.groupBy(collate.folded("word").alias("folded")).agg(F.count("*").alias("n_folded"))
    plain = rows.groupBy(collate.plain("word").alias("plain")).agg(F.count("*").alias("n_plain"))
    places = merge.numbered(rows.select("word").distinct().withColumn("key", collate.ordered("word", "de")), ["key"], 0, "place").select(F.col("word").alias("w"), F.col("place").cast("int").alias("place"))
    found = rows.join(folded, collate.folded("word") == F.col("folded")).join(plain, collate.plain("word") == F.col("plain")).join(places, F.col("word") == F.col("w"))
    return found.select("c_custkey", "word", "n_folded", "n_plain", (collate.folded("word") == F.lit("STRASSE")).alias("is_street"), "place")


ANSWERS = [
    '{"readings":[{"value":12.5,"unit":"V"},{"value":"7","unit":"ohm"}]}', '{"result":{"readings":[{"value":{"value":3,"unit":"A"}}]},"note":"nested"}', '[{"value":1.5},2,"three"]', '"no reading"', '{"readings": [', '{"readings":"none"}',
]


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'array' WHEN 3 THEN 'scalar' WHEN 4 THEN 'broken' WHEN 5 THEN 'object' END AS form,
CASE event_id % 7 WHEN 0 THEN '12.5 V|7.0 ohm' WHEN 1 THEN '3.0 A' WHEN 2 THEN '1.5 -|2.0 -|- -' ELSE '' END AS readings, CASE event_id % 7 WHEN 1 THEN 'nested' END AS note FROM events""")
def open_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six forms and none at all: nested, listed, plain, broken."""
    answer = F.get(F.array(*map(F.lit, ANSWERS)), (F.col("event_id") % 7).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", extraction.open_answer(answer).alias("a"))
    told = F.transform("a.readings", lambda r: F.concat(F.coalesce(r["value"].cast("string"), F.lit("-")), F.lit(" "), F.coalesce(r["unit"], F.lit("-"))))
    return rows.select("event_id", "a.form", F.array_join(told, "|").alias("readings"), F.try_variant_get("a.value", "$.note", "string").alias("note"))


@query(every["replace_tier"])
def tier_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace_tier on a table in partitions: only the tier's own files are written."""
    path = shared_dir(spark, "tiers") + "/orders"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.partitionBy("o_orderstatus").parquet(path)
    new = table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("o_orderkey"), F.lit("P").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    merge.reload_tiers(new, path, "o_orderstatus", ["P"])
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(path)


MAX_ROWS, MAX_BYTES = 40, 4000
_requests = every["batch_requests"].replace("SELECT ", "SELECT c_custkey, 'c' || CAST(c_custkey AS VARCHAR) AS custom_id, ", 1)
_cut = """{n}s AS (SELECT *, octet_length(encode(value)) AS size FROM {rows}), {n}p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {n}s WINDOW w AS (ORDER BY c_custkey)),
{n} AS (SELECT c_custkey, custom_id, {first} + dense_rank() OVER (ORDER BY place // {r}, before // ({b} - (SELECT max(size) FROM {n}s))) AS batch FROM {n}p)"""


@query(f"""WITH requests AS ({_requests}), early AS (SELECT * FROM requests WHERE c_custkey % 3 > 0), {_cut.format(n="one", rows="early", first="0", r=MAX_ROWS, b=MAX_BYTES)},
late AS (SELECT * FROM requests WHERE custom_id NOT IN (SELECT custom_id FROM one WHERE batch % 2 = 0 OR c_custkey % 10 > 0)), {_cut.format(n="two", rows="late", first="(SELECT max(batch) FROM one)", r=MAX_ROWS, b=MAX_BYTES)}
SELECT 1 AS run, custom_id, CAST(batch AS BIGINT) AS batch FROM one UNION ALL SELECT 2, custom_id, CAST(batch AS BIGINT) FROM two""")
def submit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a submission: the first sends two thirds; when half of its batches have ended, the second sends the rest and what failed in those, in batches behind the first's."""
    custom_id = F.get_json_object("value", "$.custom_id")
    targets = written(outputs.QUERIES["batch_requests"](spark, sf_dir).withColumns({"custom_id": custom_id, "key": F.substring(custom_id, 2, 20).cast("long")}), "requests")
    none = spark.createDataFrame([], "custom_id string, status string")
    sent, batches = spark.createDataFrame([], "custom_id string, batch_id long"), spark.createDataFrame([], "batch_id long, requests long, status string")
    one = written(submission.submit(targets.filter("key % 3 > 0"), none, sent, batches, ["key"], MAX_ROWS, MAX_BYTES), "first-run")
    sent, batches = submission.opened(one)
    batches = batches.withColumn("status", F.when(F.col("batch_id") % 2 == 1, "ended").otherwise(F.col("status")))
    done = one.filter("batch % 2 = 1").select("custom_id", F.when(F.col("key") % 10 > 0, "ok").otherwise("errored").alias("status"))
    two = submission.submit(targets, done, sent, batches, ["key"], MAX_ROWS, MAX_BYTES)
    return one.select(F.lit(1).alias("run"), "custom_id", "batch").unionByName(two.select(F.lit(2).alias("run"), "custom_id", "batch"))


_kinds = ["ok", "max_tokens", "refusal", "errored", "canceled", "odd"]


@query("SELECT o_custkey % 50 AS batch_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_n, round(coalesce(sum(o_totalprice) FILTER (kind = '{k}'), 0), 4) AS {k}_cost_usd" for k in (*jobs.RESULTS, "other")) + """
FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'refusal' WHEN 3 THEN 'errored' WHEN 4 THEN 'canceled' ELSE 'other' END AS kind FROM orders) GROUP BY 1""")
def batch_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of batches in one row each."""
    status = F.get(F.array(*map(F.lit, _kinds)), (F.col("o_orderkey") % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), status.alias("status"), F.col("o_totalprice").alias("cost_usd"))
    return jobs.batch_counters(rows)


@query(f"""WITH {ALL}, pairs AS (SELECT make, model, year_start, id, cluster_id FROM vehicles LEFT JOIN membership ON id = vehicle_id AND scope = 'engine-loop')
SELECT CAST(row_number() OVER (ORDER BY make, model, year_start, id, cluster_id NULLS FIRST) AS BIGINT) AS line, id, cluster_id FROM pairs""")
def ordered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export's lines in its final order, by make, model and first year, numbered by ranges."""
    edges = membership(spark, sf_dir).filter("scope = 'engine-loop'")
    rows = flat_rows(vehicles(spark, sf_dir), clusters(spark, sf_dir), edges, keep_alone=True)
    return merge.numbered(rows, ["make", "model", "year_start", "id", "cluster_id"], column="line").select("line", "id", "cluster_id")


@query("""SELECT 'p' || CAST(s_suppkey AS VARCHAR) || '.json' AS file, 'p' || CAST(s_suppkey AS VARCHAR) AS id, CAST(4 AS INTEGER) AS gates, CASE WHEN s_suppkey % 2 = 0 THEN 'no start' ELSE 'stalls' END AS symptom,
CAST(row_number() OVER (ORDER BY 'p' || CAST(s_suppkey AS VARCHAR) || '.json') AS BIGINT) AS place FROM supplier""")
def pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack file for each supplier, scanned in the order of names."""
    key, root = F.col("s_suppkey"), shared_dir(spark, "packs")
    name = F.concat(F.lit("p"), key.cast("string"))
    symptom = F.when(key % 2 == 0, "no start").otherwise("stalls")
    text = F.replace(F.replace(F.lit(json.dumps(PACK, indent=1)), F.lit('"events_pack"'), F.concat(F.lit('"'), name, F.lit('"'))), F.lit('"event"'), F.concat(F.lit('"'), symptom, F.lit('"')))
    write_text_files(table(spark, sf_dir, "supplier").select(F.concat(name, F.lit(".json")).alias("path"), text.alias("content")), root).count()
    found = packs.read_packs(spark, root).select("file", "id", F.size("gates").alias("gates"), F.get("symptoms", F.lit(0)).alias("symptom"))
    return merge.numbered(found, ["file"], column="place")


@query("""WITH files AS (SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id % 5 = 0 AS gone, CASE WHEN doc_id % 3 = 0 THEN 'changed to one line' ELSE 'note ' || CAST(doc_id AS VARCHAR) END AS text FROM documents)
SELECT path, CAST(1 AS BIGINT) AS chunks, text FROM files WHERE NOT gone""")
def pruned_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of files behind a second ingest: of changed ones the new chunks only, of files that are gone nothing."""
    key = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(key, F.concat(F.lit("f"), key.cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("note "), key.cast("string")).alias("text"))
    files = lambda rows, text: with_reasons(rows.select("path", text.cast("binary").alias("content")))
    known, _ = ingest(files(own, F.when(key % 3 == 0, F.repeat(F.lit("many words "), 200)).otherwise(F.col("text"))), no_knowledge(spark))
    known = Knowledge(*(written(x, "known") for x in known))
    known, _ = ingest(files(own.filter(key % 5 > 0), F.when(key % 3 == 0, "changed to one line").otherwise(F.col("text"))), known, prune=True)
    return known.files.join(known.chunks.select("path", "text"), "path").select("path", "chunks", "text")

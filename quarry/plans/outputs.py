"""Queries for what the engine reads from files and writes to them, and for worded results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import audit, extraction
from quarry.functions.gates import spec_text
from quarry.operators import jobs, pool, quality
from quarry.operators.shared import shared_dir
from quarry.sources import sinks, tables

from .entities import ALL, clusters, line_tasks, membership, table, vehicles

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_type || '"' AS label, CASE WHEN p_size % 3 > 0 THEN p_brand || chr(10) || 'line two' END AS note FROM part""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV with quotes, commas and line ends, and scanned again with all columns as text."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("label"), F.when(F.col("p_size") % 3 > 0, F.concat("p_brand", F.lit("\nline two"))).alias("note"))
    path = f"{shared_dir(spark, 'csv')}/t"
    sinks.write_csv(rows, path)
    return tables.read_csv(spark, path)


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and scanned again by a schema."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    path = f"{shared_dir(spark, 'json')}/t"
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("""SELECT 'f' || CAST(p_partkey AS VARCHAR) || '.csv' AS source_file, CAST(line AS BIGINT) AS "row", CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS make, CAST(CASE WHEN line = 1 THEN 1990 + p_size % 9 END AS INTEGER) AS year_start, CAST(CASE WHEN line = 1 THEN 1990 + p_size % 9 + p_size % 3 * 4 END AS INTEGER) AS year_end,
CASE line WHEN 1 THEN p_name ELSE 'Bus load' END AS quantity, CASE line WHEN 2 THEN p_size + 0.5 END AS value, CASE line WHEN 1 THEN CAST(p_size AS DOUBLE) END AS vmin, CASE line WHEN 1 THEN 60.0 END AS vmax, CASE line WHEN 1 THEN 'V' ELSE 'ohm' END AS unit,
CASE line WHEN 1 THEN replace(p_name, ' ', '_') || '_key_off' ELSE 'ecu_' || CAST(p_size % 4 AS VARCHAR) || '.bus_load' END AS spec_key FROM part, range(1, 3) l(line) WHERE p_size % 5 > 0 OR line = 1""")
def spec_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec table as a CSV file for each part, with one of two headers: its rows normalised, those without a quantity or a number left out."""
    key, size, name = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_name")
    make = F.when(size % 2 == 0, F.col("p_brand")).otherwise("")
    years = F.concat((1990 + size % 9).cast("string"), F.when(size % 3 > 0, F.concat(F.lit("-"), (1990 + size % 9 + size % 3 * 4).cast("string"))).otherwise(""))
    head = F.when(size % 2 == 0, " Make ,YEARS,ecu,Parameter,Nominal,Minimum,vmax,Units,condition\n").otherwise("make,yr,family,quantity,value,min,maximum,unit,state\n")
    first = F.concat(make, F.lit(","), years, F.lit(",,"), name, F.lit(",nan,"), size.cast("string"), F.lit(",60,V,key off\n"))
    second = F.concat(make, F.lit(",,ECU "), (size % 4).cast("string"), F.lit(",Bus load,"), F.when(size % 5 > 0, F.concat(size.cast("string"), F.lit(".5"))).otherwise("unknown"), F.lit(",,,ohm,\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("docs/f"), key, F.lit(".csv")).alias("path"), F.lit("csv").alias("suffix"), F.concat(head, first, second, F.lit(",,,,5,,,,\n")).cast("binary").alias("content")).repartition("path")
    good, _, _ = tables.specs_of_cells(tables.cells_of(files))
    return good.select("source_file", "row", "make", "year_start", "year_end", "quantity", "value", "vmin", "vmax", "unit", "spec_key")


@query("""SELECT p_partkey AS part, CASE p_size % 4 WHEN 0 THEN '>= ' || CAST(p_size AS VARCHAR) || ' V [a.pdf p.3]' WHEN 1 THEN CAST(p_size AS VARCHAR) || '–60.5 V [a.pdf p.3]' WHEN 2 THEN '≥ ' || CAST(p_size AS VARCHAR) || ' V [a.pdf p.3]' ELSE CAST(p_size AS VARCHAR) || ' V [a.pdf p.3]' END AS told FROM part""")
def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a spec reads: thresholds with their operator, windows as ranges, others as a value or a bound."""
    size, none = F.col("p_size").cast("double"), F.lit(None).cast("double")
    kind = F.col("p_size") % 4
    told = spec_text(F.when(kind == 0, "threshold").otherwise("window"), F.lit(">="), F.when(kind.isin(0, 3), size).otherwise(none), F.when(kind.isin(1, 2), size).otherwise(none), F.when(kind == 1, F.lit(60.5)).otherwise(none), F.lit("V"), F.lit("a.pdf p.3"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), told.alias("told"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'label ' || CAST(s_nationkey AS VARCHAR) ELSE '—' END AS qualifier FROM supplier")
def qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    note, label = F.when(key % 3 == 0, F.col("s_name")).when(key % 2 == 0, ""), F.when(key % 3 == 1, F.concat(F.lit("label "), F.col("s_nationkey").cast("string"))).otherwise("")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), pool.qualifier(note, label).alias("qualifier"))


@query("""SELECT '{"custom_id":"c' || CAST(c_custkey AS VARCHAR) || '","params":{"model":"m-1","max_tokens":3500,"messages":[{"role":"user","content":"Write about ' || c_name || ' \\"' || c_mktsegment || '\\""}]}}' AS value FROM customer""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("custom_id"), "c_name", "c_mktsegment")
    return sinks.request_lines(rows, F.concat(F.lit("Write about "), "c_name", F.lit(' "'), "c_mktsegment", F.lit('"')), "m-1", 3500)


@query("""SELECT 'supplier_' || CAST(s_suppkey AS VARCHAR) || '/job_' || CAST(s_nationkey AS VARCHAR) || '.md' AS path, CAST(octet_length(encode('# Supplier ' || CAST(s_suppkey AS VARCHAR) || ': Job ' || CAST(s_nationkey AS VARCHAR) || chr(10) || chr(10) || 'é ' || s_name || chr(10))) AS BIGINT) AS bytes, '# Supplier ' || CAST(s_suppkey AS VARCHAR) || ': Job ' || CAST(s_nationkey AS VARCHAR) AS first_line FROM supplier""")
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs as files in folders, read back by the paths of their index."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier "), key).alias("cluster_id"), F.lit("s").alias("scope"), F.concat(F.lit("Job "), nation).alias("job"), F.lit("m").alias("model"), F.concat(F.lit("é "), "s_name").alias("content"), F.lit("t").alias("created_at"))
    root = shared_dir(spark, "jobs")
    sinks.write_job_files(rows, root)
    index = spark.read.text(f"{root}/index/*.txt").filter("value like '{%'").select(F.get_json_object("value", "$.path").alias("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    found = files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.split(F.col("content").cast("string"), "\n")[0].alias("first_line"))
    return index.join(found, "path")


@query("""SELECT upper('1hgcm826' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS vin, CAST(1990 + c_nationkey AS VARCHAR) AS year, c_mktsegment AS make, c_name AS model, CASE WHEN c_custkey % 2 = 0 THEN 'EX' ELSE '' END AS trim, '' AS series, 'K20 ' || CAST(c_nationkey % 8 + 1 AS VARCHAR) || ' 2.0' AS engine FROM customer WHERE c_custkey % 5 > 0""")
def vin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder answers in their plain form; short numbers are refused."""
    key = F.col("c_custkey")
    answer = F.to_json(F.struct(F.array(F.create_map(
        F.lit("Make"), F.col("c_mktsegment"), F.lit("Model"), F.col("c_name"), F.lit("ModelYear"), (1990 + F.col("c_nationkey")).cast("string"), F.lit("Trim"), F.when(key % 2 == 0, "EX").otherwise(""),
        F.lit("EngineModel"), F.lit("K20"), F.lit("EngineCylinders"), (F.col("c_nationkey") % 8 + 1).cast("string"), F.lit("DisplacementL"), F.lit("2.0"),
    )).alias("Results")))
    vin = F.when(key % 5 > 0, F.concat(F.lit(" 1hgcm826"), F.lpad(key.cast("string"), 6, "0"))).otherwise(F.concat(F.lit("io"), F.lpad(key.cast("string"), 12, "0")))
    return sinks.vin_values(table(spark, sf_dir, "customer").select(vin.alias("vin"), answer.alias("payload")))


@query("""SELECT p_partkey AS part, CASE p_size % 6 WHEN 0 THEN 'The supply reads ' || CAST(p_size AS VARCHAR) || ' now.' WHEN 5 THEN 'Look at the plug.' || chr(10) || 'Is it dry?' END AS reply FROM part""")
def guarded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worded replies that may be shown: none that asks twice, names an outcome, tells a number that nobody gave, is empty, or stands at a step of risk."""
    size = F.col("p_size")
    kinds = [F.concat(F.lit("The supply reads "), size.cast("string"), F.lit(" now.")), F.lit("Is it dry? Is it clean?"), F.lit("So the supply failed."), F.concat(F.lit("It should read "), (size + 100).cast("string"), F.lit(".")), F.lit("COMMIT: DEV-BRANCH-GATE-A-PASS\n"), F.lit("COMMIT: DEV-BRANCH-INTAKE\nLook at the plug.\nIs it dry?")]
    body = F.get(F.array(*kinds), (size % 6).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), audit.guarded(body, F.array(F.concat(F.lit("given: "), size.cast("string")))).alias("reply"))
    return rows


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '1.5 V null|7.25 null RUNNING' WHEN event_id % 4 = 1 THEN '1.5 V null|3.0 A KOEO' WHEN event_id % 4 = 2 THEN '1.5 V null' ELSE '1.5 V null' END AS readings, CASE WHEN event_id % 4 = 1 THEN 'P0101 U0100' ELSE 'P0101' END AS codes, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS yes_no FROM events""")
def merged_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the patterns with those of an injected extractor's JSON; what is no number, no known state or no JSON adds nothing."""
    answers = [
        '{"readings":[{"value":"7.25","unit":"null","state":"RUNNING"},{"value":"x","unit":"V"}],"yes_no":true}', '{"readings":[{"value":"3","unit":"A","state":"ODD"}],"dtcs":["u0100","p0101"],"yes_no":false}',
        '{"readings":[{"unit":"V"}],"dtcs":[]}', "no json",
    ]
    event = F.col("event_id") % 4
    answer = F.get(F.array(*map(F.lit, answers)), event.cast("int"))
    text = F.when(event == 1, "1.5 volts, P0101 at key on").otherwise("1.5 volts, P0101")
    own = F.transform(extraction.readings(text), lambda r: F.struct(r["value"].alias("value"), r["unit"].alias("unit"), F.lit(None).cast("string").alias("state"), r["clause"].alias("clause")))
    merged = extraction.merge_extracted(own, extraction.trouble_codes(text), F.lit(None).cast("boolean"), answer, text)
    told = lambda r: F.concat_ws(" ", r["value"].cast("string"), F.coalesce(r["unit"], F.lit("null")), F.coalesce(r["state"], F.lit("null")))
    rows = table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    return rows.select("event_id", F.array_join(F.transform("m.readings", told), "|").alias("readings"), F.array_join("m.codes", " ").alias("codes"), "m.yes_no")


VALIDATED = f"""WITH {ALL}, edges AS (SELECT DISTINCT vehicle_id, cluster_id FROM membership JOIN clusters USING (cluster_id) WHERE type = 'structural'),
known AS (SELECT cluster_id, id, construction, drive, CAST(wheelbase AS DOUBLE) AS base, year_start, year_end FROM edges JOIN vehicles ON id = vehicle_id),
drives AS (SELECT cluster_id, id, unnest(list_distinct(list_filter(list_transform(string_split(drive, ','), lambda x: trim(x)), lambda x: x <> ''))) AS d FROM known),
shared AS (SELECT cluster_id, max(n) AS most FROM (SELECT cluster_id, d, count(*) AS n FROM drives GROUP BY 1, 2) GROUP BY 1), driven AS (SELECT cluster_id, count(DISTINCT id) AS n FROM drives GROUP BY 1),
facts AS (SELECT cluster_id, count(*) AS members, count(DISTINCT nullif(construction, '')) > 1 AS c, max(base) - min(base) > 1 AS w, max(year_start) > min(year_end) AS y FROM known GROUP BY 1),
flags AS (SELECT cluster_id FROM facts LEFT JOIN shared USING (cluster_id) LEFT JOIN driven USING (cluster_id) WHERE members > 1 AND (c OR coalesce(n > 0 AND most < n, false) OR w OR y))
SELECT (SELECT count(*) FROM clusters WHERE type = 'structural') AS structural_clusters, (SELECT count(*) FROM flags) AS flagged_clusters, (SELECT count(*) FROM flags) AS verdict_rows"""


@query(VALIDATED)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole check, twice over, so that the second must replace the first one's verdicts."""
    cars, groups = vehicles(spark, sf_dir).withColumn("model", F.concat("model", F.lit(" "), F.col("id").cast("string"))), clusters(spark, sf_dir)
    edges = membership(spark, sf_dir).dropDuplicates(["vehicle_id", "cluster_id"])
    log = spark.createDataFrame([], "date string, part string, method string, cluster_id string, result string, notes string")
    tasks = line_tasks(spark, sf_dir)
    edges, log = quality.validate(cars, groups, edges, log, F.lit("2024-01-01"), tasks)
    return quality.summary(groups, *quality.validate(cars, groups, edges, log, F.lit("2024-01-02"), tasks))


@query("""SELECT scope, cluster_id, job FROM (SELECT o_orderpriority AS scope, CAST(o_custkey AS VARCHAR) AS cluster_id, min(o_orderkey) AS o FROM orders GROUP BY 1, 2), (VALUES ('1-URGENT', 'brakes'), ('1-URGENT', 'fuel'), ('2-HIGH', 'brakes'), ('3-MEDIUM', 'fuel')) j(s, job)
WHERE s = scope AND scope IN ('1-URGENT', '2-HIGH') AND cluster_id IN ('1', '2', '5', '77')""")
def scoped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of two scopes and four clusters only."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_custkey").cast("string").alias("cluster_id"), F.lit("m").alias("make"), F.lit("x").alias("model"), F.lit(2000).alias("year_start"), F.lit(2001).alias("year_end"), F.lit("").alias("note"), F.col("o_orderkey").alias("ord"))
    own = spark.createDataFrame([("1-URGENT", "brakes", 0), ("1-URGENT", "fuel", 1), ("2-HIGH", "brakes", 0), ("3-MEDIUM", "fuel", 0)], "scope string, job string, ord int")
    return jobs.targets(rows, own, ["1-URGENT", "2-HIGH"], ["1", "2", "5", "77"]).select("scope", "cluster_id", "job")


@query("""SELECT p_partkey AS place, CAST(p_partkey AS VARCHAR) || '|' || p_name || ' "x"|' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'null' END AS row, (SELECT count(*) FROM part) AS row_count FROM part""")
def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export as one JSON document, its rows and its count read back line by line."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' "x"')).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    path = f"{shared_dir(spark, 'export')}/t"
    sinks.export_document(rows, rows.columns, ["id"], path, "2024-01-01T00:00:00Z")
    lines = spark.read.text(path)
    count = lines.filter("value like '{%'").select(F.regexp_extract("value", '"row_count":([0-9]+)', 1).cast("long").alias("row_count"))  # one line
    cells = F.from_json(F.rtrim("value", F.lit(",")), "array<string>")
    found = lines.filter("value like '[%'").select(cells.alias("c"))
    told = F.array_join("c", "|", "null")
    return found.select(F.get("c", F.lit(0)).cast("long").alias("place"), told.alias("row")).join(F.broadcast(count))


@query("""SELECT 'nation' AS part, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS row FROM nation UNION ALL SELECT 'edge', CAST(n_regionkey AS VARCHAR) || '|' || CAST(n_nationkey AS VARCHAR) || '|e' FROM nation UNION ALL SELECT 'region', '"' || CAST(r_regionkey AS VARCHAR) || '":["structural","' || r_name || '"]' FROM region""")
def compact_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compact catalogue of nations, edges and regions, read back line by line."""
    nations = table(spark, sf_dir, "nation")
    path = f"{shared_dir(spark, 'compact')}/t"
    groups = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("cluster_id"), F.lit("structural").alias("type"), F.col("r_name").alias("label"))
    sinks.compact(nations.select("n_nationkey", "n_name"), groups, nations.select("n_regionkey", "n_nationkey", F.lit("e").alias("scope")), path)
    line = F.rtrim("value", F.lit(","))
    cells = F.from_json(line, "array<string>")
    rows = spark.read.text(path).filter("value rlike '^[\\\\[\"]'")
    part = F.when(F.col("value").startswith('"'), "region").when(F.size(cells) == 2, "nation").otherwise("edge")
    return rows.select(part.alias("part"), F.when(part == "region", line).otherwise(F.array_join(cells, "|")).alias("row"))


@query("""SELECT '<script>const D=["' || string_agg(r_name || '<\\/b>', '","' ORDER BY r_regionkey) || '"],T="a page";</script>' AS page FROM region""")
def bundled_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' few names inside a page, safe within its script."""
    names = [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.concat("r_name", F.lit("</b>"))).collect()]
    page = sinks.bundle('<script>const D=__DATA__,T="__TITLE__";</script>', {"__DATA__": names, "__TITLE__": "a page"})
    return spark.createDataFrame([(page,)], "page string")

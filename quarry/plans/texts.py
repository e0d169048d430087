"""Queries for chunks, retrieval, extraction and audit, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import audit, extraction
from quarry.operators import inverted, packs, retrieval
from quarry.operators.shared import shared_dir
from quarry.sources import layout
from quarry.sources.datasource import register
from quarry.sources.documents import ingest, no_knowledge, sections, with_reasons
from quarry.sources.sinks import vin_fields, write_text_files
from quarry.streaming.ingest import ingest_stream, reports, upsert

from .entities import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE plain AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
cuts AS (
  SELECT doc_id, t, 0 AS ord, 0 AS a, CASE WHEN length(t) <= 800 THEN length(t) ELSE coalesce(nullif(680 + 120 - instr(reverse(substr(t, 681, 120)), ' '), CASE WHEN instr(reverse(substr(t, 681, 120)), ' ') = 0 THEN 800 ELSE -1 END), 800) END AS b FROM plain WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, ord + 1, greatest(b - 100, a + 1) AS a,
    CASE WHEN length(t) <= greatest(b - 100, a + 1) + 800 THEN length(t)
    WHEN instr(reverse(substr(t, greatest(b - 100, a + 1) + 681, 120)), ' ') = 0 THEN greatest(b - 100, a + 1) + 800
    ELSE greatest(b - 100, a + 1) + 800 - instr(reverse(substr(t, greatest(b - 100, a + 1) + 681, 120)), ' ') END AS b
  FROM cuts WHERE b < length(t))
SELECT doc_id, ord, trim(substr(t, a + 1, b - a)) AS text FROM cuts WHERE trim(substr(t, a + 1, b - a)) <> ''""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH docs AS (SELECT doc_id, doc_id % 2 = 0 AS md, string_split(replace(text, '. ', chr(10) || '# '), chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, md, generate_subscripts(lines, 1) AS line, unnest(lines) AS words FROM docs),
heads AS (SELECT *, CASE WHEN md THEN nullif(regexp_extract(words, '^#{1,6}\\s+(.*\\S)\\s*$', 1), '') END AS head FROM rows),
placed AS (SELECT *, sum(CASE WHEN head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS place FROM heads)
SELECT * FROM (SELECT doc_id, CAST(place AS BIGINT) AS place, coalesce(max(head), '') AS section, regexp_replace(coalesce(string_agg(words, chr(10) ORDER BY line) FILTER (head IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS text FROM placed GROUP BY doc_id, place) WHERE text <> ''""")
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n# ")).alias("text"), (F.col("doc_id") % 2 == 0).alias("md"))
    return sections(rows, "doc_id", headings="md")


QUESTIONS = "SELECT item_id AS query_id, text AS query FROM benchmark"
BM25 = f"""WITH asked AS (SELECT DISTINCT query_id, lower(t) AS term FROM (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9]{{2,}}')) AS t FROM ({QUESTIONS})) WHERE lower(t) NOT IN ({", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)})),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY 1, 2),
lengths AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS length FROM documents),
total AS (SELECT count(*) AS n_rows, avg(length) AS mean_length FROM lengths),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
scores AS (SELECT query_id, doc_id, -sum(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM asked JOIN post USING (term) JOIN df USING (term) JOIN lengths USING (doc_id) CROSS JOIN total GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS place FROM scores) WHERE place <= {{k}}"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(BM25.replace("{k}", "4"))
def bm25_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query(f"""WITH found AS ({BM25.replace("{k}", "12")}), marked AS (SELECT f.*, doc_id % 5 = query_id % 5 AS mentions FROM found f)
SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY mentions DESC, place) AS place FROM marked) WHERE place <= 4""")
def bm25_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many candidates, those that are marked first, cut to four."""
    docs = table(spark, sf_dir, "documents")
    found = retrieval.bm25(_questions(spark, sf_dir), docs, "doc_id", "text", k=12).drop("place")
    return retrieval.rerank(found, docs.select("doc_id"), "doc_id", F.col("doc_id") % 5 == F.col("query_id") % 5, 4).select("query_id", "doc_id", "place")


#: A small vocabulary, form and Porter stem, to print sections of. The stems are fixed values.
STEMS = {
    "crank": "crank", "cranks": "crank", "cranking": "crank", "cranked": "crank", "battery": "batteri", "batteries": "batteri", "voltage": "voltag", "voltages": "voltag", "relational": "relat", "relate": "relat",
    "sensor": "sensor", "sensors": "sensor", "hopping": "hop", "hopefulness": "hope", "hope": "hope", "ground": "ground", "grounded": "ground", "fuses": "fuse", "fuse": "fuse", "running": "run", "runs": "run", "dry": "dry", "dries": "dri",
}
ASKED = ["cranking batteries", "the voltages of a sensor", "hoping to relate grounds", "fused running crank cranked", "dry"]
_asked_stems = {"hoping": "hope", "grounds": "ground", "fused": "fuse"}


@query(f"""WITH stems(form, stem) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in (STEMS | _asked_stems).items())}),
forms AS (SELECT list(form ORDER BY n) AS f FROM (VALUES {", ".join(f"('{a}', {i})" for i, a in enumerate(STEMS))}) t(form, n)),
asked AS (SELECT query_id, stem AS term, count(*) AS times FROM (SELECT query_id, unnest(string_split(q, ' ')) AS form FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))}) q(query_id, q)) JOIN stems USING (form) GROUP BY 1, 2),
rows AS (SELECT p_partkey AS part, f[1 + p_partkey % 23] || ' ' || f[1 + p_size % 23] || ' ' || f[1 + (p_partkey * 7 + p_size) % 23] || ' ' || repeat(f[1 + p_size % 5] || ' ', CAST(p_size % 4 AS BIGINT)) AS text, f[1 + p_partkey % 11] AS section FROM part, forms),
words AS (SELECT part, form, stem FROM (SELECT part, unnest(string_split(trim(text) || ' ' || section, ' ')) AS form FROM rows) JOIN stems USING (form)),
lengths AS (SELECT part, count(*) AS length FROM words GROUP BY 1), total AS (SELECT count(*) AS n_rows, avg(length) AS mean_length FROM lengths),
post AS (SELECT stem AS term, part, count(*) AS tf FROM words GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
scores AS (SELECT query_id, part, -sum(times * CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score FROM asked JOIN post USING (term) JOIN df USING (term) JOIN lengths USING (part) CROSS JOIN total GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, part, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), part) AS place FROM scores) WHERE place <= 4""")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval by stems over text and section, on sections printed from a vocabulary whose stems are known."""
    questions = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    found = retrieval.bm25(questions, _printed(spark, sf_dir), "part", ["text", "section"], stem=True)
    return found.select("query_id", "part", F.round("score", 6).alias("score"), "place")


@query(ORACLE_SQL["bm25_stemmed"])
def indexed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a kept index: a first ingest with other texts for a third of the files and files that are no more, a second of what changed, then a merge."""
    rows, part = _printed(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.floor(F.col("part") / 4).cast("string"))), F.col("part")
    root = shared_dir(spark, "index")
    other = F.floor(part / 4) % 3 == 0
    before = rows.withColumns({"text": F.when(other, F.concat("section", F.lit(" battery "), "section")).otherwise(F.col("text"))})
    lost = rows.withColumns({"file": F.concat(F.lit("lost"), "file"), "part": part + 10**9})
    inverted.add(before.unionByName(lost.filter(part % 5 == 0)), root, "file", "part", ["text", "section"], stem=True)
    inverted.add(rows.filter(other), root, "file", "part", ["text", "section"], gone=lost.select("file").distinct(), stem=True)
    inverted.merge(spark, root)
    questions = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    # keys are kept as text, so ties are settled here
    found = inverted.search(questions, root, None).withColumn("part", F.col("row").cast("long"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "part"))
    return found.withColumn("place", place).filter("place <= 4").select("query_id", "part", F.round("score", 6).alias("score"), "place")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, text and section, printed from the vocabulary."""
    part, size, forms = F.col("p_partkey"), F.col("p_size"), F.array(*map(F.lit, STEMS))
    form = lambda x: F.get(forms, x.cast("int"))
    text = F.concat_ws(" ", form(part % 23), form(size % 23), form((part * 7 + size) % 23), F.repeat(F.concat(form(size % 5), F.lit(" ")), (size % 4).cast("int")))
    return table(spark, sf_dir, "part").select(part.alias("part"), text.alias("text"), form(part % 11).alias("section"))


@query("""WITH RECURSIVE files AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.csv' WHEN 3 THEN '.png' WHEN 4 THEN '' WHEN 5 THEN '.pdf' ELSE '.TXT' END AS suffix, coalesce(text, '') AS text, doc_id % 11 = 0 AS known FROM documents),
plain AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM files WHERE lower(suffix) IN ('.md', '.txt', '.pdf') AND NOT known),
cuts AS (SELECT doc_id, t, 0 AS a, CASE WHEN length(t) <= 800 THEN length(t) WHEN instr(reverse(substr(t, 681, 120)), ' ') = 0 THEN 800 ELSE 800 - instr(reverse(substr(t, 681, 120)), ' ') END AS b FROM plain WHERE t <> ''
  UNION ALL SELECT doc_id, t, greatest(b - 100, a + 1) AS a, CASE WHEN length(t) <= greatest(b - 100, a + 1) + 800 THEN length(t) WHEN instr(reverse(substr(t, greatest(b - 100, a + 1) + 681, 120)), ' ') = 0 THEN greatest(b - 100, a + 1) + 800
    ELSE greatest(b - 100, a + 1) + 800 - instr(reverse(substr(t, greatest(b - 100, a + 1) + 681, 120)), ' ') END AS b FROM cuts WHERE b < length(t)),
counts AS (SELECT doc_id, count(*) FILTER (trim(substr(t, a + 1, b - a)) <> '') AS n FROM cuts GROUP BY 1),
told AS (SELECT f.*, CASE WHEN suffix IN ('', '.png') THEN 'unsupported type ' || CASE suffix WHEN '' THEN '(none)' ELSE suffix END WHEN known THEN 'unchanged' WHEN suffix = '.pdf' AND contains(text, '@') THEN 'unreadable pdf: an address' WHEN suffix <> '.csv' AND coalesce(n, 0) = 0 THEN 'no extractable text' END AS reason, coalesce(n, 0) AS n FROM files f LEFT JOIN counts USING (doc_id))
SELECT 'sub' || CAST(doc_id % 3 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || suffix AS path, reason, CASE WHEN reason IS NULL AND suffix <> '.csv' THEN 1 ELSE 0 END AS pages, CASE WHEN reason IS NULL AND suffix <> '.csv' THEN n ELSE 0 END AS chunks,
CASE WHEN reason IS NULL AND suffix = '.csv' THEN 2 ELSE 0 END AS spec_rows, CASE WHEN reason IS NULL AND suffix = '.csv' THEN 1 ELSE 0 END AS skipped_rows FROM told""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds, some of them known already, some of no known type, some unreadable: what an ingest makes of each."""

    rows = _as_files(table(spark, sf_dir, "documents"))
    files = with_reasons(rows)
    known = no_knowledge(spark)
    seen = with_reasons(rows.filter(F.col("doc_id") % 11 == 0)).select("path", "sha256", *(F.lit(0).cast("long").alias(c) for c in ("pages", "chunks", "spec_rows")))
    _, report = ingest(files, known._replace(files=seen), _extract)
    return report


def _extract(content: bytes) -> list[str]:
    if b"@" in content:
        raise ValueError("an address")
    return [content.decode("utf-8")]


def _as_files(documents: DataFrame) -> DataFrame:
    """doc_id, path and content of documents as files of several kinds."""
    key = F.col("doc_id")
    suffix = F.get(F.array(*map(F.lit, (".md", ".txt", ".csv", ".png", "", ".pdf", ".TXT"))), (key % 7).cast("int"))
    csv = F.concat(F.lit("Parameter,Nominal,Units\nsupply,"), key.cast("string"), F.lit(",V\nnothing,,V\nbus,60,ohm\n"))
    return documents.select("doc_id", F.concat(F.lit("sub"), (key % 3).cast("string"), F.lit("/"), key.cast("string"), suffix).alias("path"), F.when(key % 7 == 2, csv).otherwise(F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


#: Known are those of the first batch that could be ingested.
STREAMED = ORACLE_SQL["ingest_report"].replace("doc_id % 11 = 0 AS known", "coalesce(doc_id % 11 = 0 AND (suffix = '.csv' OR (trim(regexp_replace(documents.text, '\\s+', ' ', 'g')) <> '' AND NOT (suffix = '.pdf' AND contains(documents.text, '@')))), false) AS known")


@query(STREAMED)
def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ingest_report as a stream, upserted behind a first batch of some of them: the report of what the stream brought."""
    root = shared_dir(spark, "ingested")
    upsert(with_reasons(_as_files(table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 == 0))), 0, root, extract=_extract)
    documents = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/documents.parquet*")
    ingest_stream(with_reasons(_as_files(documents)), root, f"{root}/checkpoint", first=1, extract=_extract).awaitTermination()
    return reports(spark, root).filter("segment > 0").drop("segment")


@query("""WITH pieces AS (SELECT doc_id // 20 AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY 1)
SELECT 'd' || CAST(n % 4 AS VARCHAR) || '/f' || CAST(n AS VARCHAR) || CASE n % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.log' END AS path, CASE n % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' ELSE 'log' END AS suffix, sha256(content) AS sha256,
CASE WHEN n % 3 = 2 THEN 'unsupported type .log' END AS reason, CAST(octet_length(encode(content)) AS INTEGER) AS bytes FROM pieces""")
def docs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of twenty documents each, written and read again by the data source."""
    root, n = shared_dir(spark, "docs"), F.floor(F.col("doc_id") / 20)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    files = table(spark, sf_dir, "documents").groupBy(n.alias("n")).agg(F.array_join(texts, "\n").alias("content"))
    suffix = F.get(F.array(*map(F.lit, (".md", ".txt", ".log"))), (F.col("n") % 3).cast("int"))
    path = F.concat(F.lit("d"), (F.col("n") % 4).cast("string"), F.lit("/f"), F.col("n").cast("string"), suffix)
    write_text_files(files.select(path.alias("path"), "content"), root).count()
    register(spark)
    return spark.read.format("quarry-docs").load(root).select("path", "suffix", "sha256", "reason", F.octet_length("content").alias("bytes"))


@query("SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS numbers FROM (SELECT doc_id, generate_subscripts(n, 1) AS i, unnest(n) AS x FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_.])([0-9]+(?:\\.[0-9]+)?)', 1) AS n FROM documents)) GROUP BY doc_id")
def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", extraction.plain_numbers("text").alias("n"))
    return rows.filter(F.size("n") > 0).select("doc_id", F.array_join("n", " ").alias("numbers"))


@query("SELECT event_id, array_to_string(list_transform(list_filter(string_split(upper(t), ' '), lambda x, i: regexp_matches(x, '^[PBCU][0-3][0-9A-F]{3}$') AND list_position(string_split(upper(t), ' '), x) = i), lambda x: x), ' ') AS codes FROM (SELECT event_id, 'p0' || lpad(CAST(user_id AS VARCHAR), 3, '0') || ' x ' || 'P0' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') || ' u3' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' p9123' AS t FROM events)")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.lpad(c.cast("string"), 3, "0")
    text = F.concat(F.lit("p0"), number(F.col("user_id")), F.lit(" x P0"), number(F.col("user_id") % 100), F.lit(" u3"), number(F.col("event_id") % 1000), F.lit(" p9123"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(extraction.trouble_codes(text), " ").alias("codes"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)^\\s*(y|yes|yeah|yep|yup|correct|right|affirmative|confirmed?|sure|ok|okay)\\b[\\s.!]*$') AS yes, regexp_matches(text, '(?i)^\\s*(n|no|nope|nah|negative|wrong|incorrect|not right)\\b[\\s.!]*$') AS no, regexp_matches(text, '(?i)^\\s*ack[\\s.!]*$') AS ack, regexp_matches(text, '(?i)\\bdtcs?\\b.*\\b(captured|recorded|saved|logged|written down)\\b') AS codes_captured,
regexp_matches(text, '(?i)\\b(unknown|don''?t know|not sure|no idea|n/?a)\\b') AS unknown, regexp_matches(text, '(?i)\\b(about|around|roughly|approximately|approx|give or take)\\b|~|-?ish\\b') AS approximate,
regexp_matches(text, '(?i)\\?|^\\s*(what|why|how|where|which|when|who|can|could|does|do|is|are|should|explain|tell me)\\b') AND NOT regexp_matches(text, '(?i)^\\s*(what now|what next|next|now what|continue|go on|and then|ready|ok go)\\W*$') AS question,
CASE WHEN regexp_matches(text, '(?i)\\b(unplugged|disconnected|connector off|harness off)\\b') THEN 'UNPLUGGED' WHEN regexp_matches(text, '(?i)\\bcrank(?:ing|s|ed)?\\b|\\bon crank\\b') THEN 'CRANKING' WHEN regexp_matches(text, '(?i)\\b(running|idling|idle|koer|engine on|engine running)\\b') THEN 'RUNNING' WHEN regexp_matches(text, '(?i)\\bkoeo\\b|\\bkey[- ]?on\\b|\\bignition on\\b|\\bengine off\\b') THEN 'KOEO' WHEN regexp_matches(text, '(?i)\\bkey[- ]?off\\b|\\bkoff\\b|\\bignition off\\b') THEN 'KEY_OFF' END AS state
FROM (SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'is it idling ' || text WHEN 2 THEN 'about 5 at key-on ' || text WHEN 4 THEN ' nope!' WHEN 5 THEN 'ACK.' WHEN 6 THEN 'the DTCs are saved, ' || text WHEN 7 THEN 'I don''t know' ELSE text END AS text FROM conversations)""")
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 8
    led = lambda words: F.concat(F.lit(words), "text")
    text = F.when(turn == 0, "Yes.").when(turn == 1, led("is it idling ")).when(turn == 2, led("about 5 at key-on ")).when(turn == 4, " nope!").when(turn == 5, "ACK.").when(turn == 6, led("the DTCs are saved, ")).when(turn == 7, "I don't know").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return rows.select("conv_id", "turn", extraction.answers("text").alias("a"), extraction.find_state("text").alias("state")).select("conv_id", "turn", "a.*", "state")


#: What a mechanic might write, by a part's size modulo nine; {n} is the size.
MESSAGES = [
    "It reads {n} volts when cranking", "the pump hums for {n} minutes after the start and then it simply stops again", "{n} kohms with the plug out, connector off; supply 5.02 V at key on",
    "we have had this car in the shop since 2004 and now the meter was showing {n}", "P0{n}3 stored. U01{n}0 too", "a {n}i with the big engine, got about {n}.5", "{n}", "pressure at idle {n}.25 kPa. 3 mA leak, 12 Hz", "between the two connectors there are some {n} old wires, which we did not count",
]


@query("""WITH own AS (SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS n, p_size % 9 AS kind FROM part),
found(kind, ord, plus, fixed, unit, state) AS (VALUES (0, 0, 0.0, NULL, 'V', 'CRANKING'), (2, 0, 0.0, NULL, 'kohm', NULL), (2, 1, NULL, 5.02, 'V', 'KOEO'), (3, 0, 0.0, NULL, NULL, NULL), (5, 0, 0.5, NULL, NULL, NULL), (6, 0, 0.0, NULL, NULL, NULL),
(7, 0, 0.25, NULL, 'kPa', 'RUNNING'), (7, 1, NULL, 3.0, 'mA', NULL), (7, 2, NULL, 12.0, 'Hz', NULL))
SELECT part, ord, coalesce(fixed, n + plus) AS value, unit, state FROM own JOIN found USING (kind)""")
def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each part: readings with unit and state, among durations, counts, years, codes and badges that are none."""
    size = F.col("p_size")
    text = F.replace(F.element_at(F.array(*map(F.lit, MESSAGES)), (size % 9 + 1).cast("int")), F.lit("{n}"), size.cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.posexplode(extraction.readings(text)).alias("ord", "r"))
    return rows.select("part", "ord", "r.value", "r.unit", "r.state")


@query("""WITH own AS (SELECT p_partkey AS part, p_name AS name, 1990 + p_size % 40 AS year, p_size % 6 AS kind, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT part, CASE kind WHEN 2 THEN a ELSE 'Acme' END AS make, CASE kind WHEN 0 THEN name WHEN 1 THEN a WHEN 2 THEN b || ' Acme' ELSE name END AS model, CAST(year AS INTEGER) AS year FROM own WHERE kind < 4""")
def text_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles named behind or before a year; none without one or where it has a unit."""
    year, name = (1990 + F.col("p_size") % 40).cast("string"), F.col("p_name")
    kinds = [
        F.concat(F.lit("my "), year, F.lit(" Acme "), name, F.lit(" with a miss")), F.concat(year, F.lit(" Acme "), F.substring_index(name, " ", 1), F.lit(" keeps stalling")), F.concat(F.lit("The "), name, F.lit(" Acme, "), year, F.lit(", and it dies")),
        F.concat(F.lit("customer came in with a: "), year, F.lit("/Acme/"), name, F.lit("/x")), F.concat(year, F.lit(" ohms on the "), name), F.concat(F.lit("an Acme "), name),
    ]
    text = F.get(F.array(*kinds), (F.col("p_size") % 6).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), extraction.subject(text).alias("s")).filter("s.make is not null").select("part", "s.*")


@query("""WITH own AS (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_.])([0-9]+(?:\\.[0-9]+)?)', 1) AS n FROM documents),
known AS (SELECT doc_id, list_transform(regexp_extract_all(n_chars || ' ' || doc_id || ' 1 2 3 555 10', '[0-9]+', 0), lambda x: CAST(x AS DOUBLE)) AS k FROM documents)
SELECT doc_id, array_to_string(list_filter(n, lambda x: NOT list_contains(k, round(CAST(x AS DOUBLE), 6))), ' ') AS wrong FROM own JOIN known USING (doc_id) WHERE len(list_filter(n, lambda x: NOT list_contains(k, round(CAST(x AS DOUBLE), 6)))) > 0""")
def reply_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.col("n_chars").cast("string"), F.col("doc_id").cast("string"), F.lit("1 2 3 555 10"))
    rows = table(spark, sf_dir, "documents").select("doc_id", audit.offending("text", allowed).alias("wrong"))
    return rows.filter(F.size("wrong") > 0).select("doc_id", F.array_join("wrong", " ").alias("wrong"))


SYMPTOMS = {"no_start": [r"\bth(en|is)\b", "crank"], "heat": ["ein", "hot"], "noise": ["eau", r"ci[oó]n"]}


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bth(en|is)\\b') OR regexp_matches(text, '(?i)crank') THEN 'no_start' WHEN regexp_matches(text, '(?i)ein') OR regexp_matches(text, '(?i)hot') THEN 'heat' WHEN regexp_matches(text, '(?i)eau') OR regexp_matches(text, '(?i)ci[oó]n') THEN 'noise' END AS pack FROM conversations")
def symptom_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.route(table(spark, sf_dir, "conversations"), SYMPTOMS).select("conv_id", "turn", "pack")


@query("""SELECT p_brand AS make, p_name AS model, p_type AS styles, CAST(p_size AS VARCHAR) || '.5' AS wheelbase, 'u' AS construction, CASE WHEN p_size % 2 = 0 THEN 'r,4' ELSE 'f' END AS drive, 1990 + p_size % 9 AS year_start, 2000 + p_size % 9 AS year_end,
CASE WHEN p_size % 3 = 0 THEN 'alt ' || CAST(p_size AS VARCHAR) ELSE '' END AS alt_models, CASE WHEN p_size % 3 = 0 THEN 'seen ' || p_type ELSE '' END AS remarks, CASE WHEN p_size % 5 > 0 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS cluster_id FROM part""")
def layout_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts printed as pages of a fixed layout, a page per ten parts and the brand only where it changes, and parsed back."""
    size, part = F.col("p_size"), table(spark, sf_dir, "part")
    column = lambda x, n: F.rpad(x, n, " ")
    file = F.expr("p_partkey div 1000")  # a file is a brand's share of a thousand parts, however many there are
    over = Window.partitionBy("p_brand", "_file").orderBy("p_partkey")
    rows = part.withColumn("_file", file).withColumn("_at", F.row_number().over(over) - 1)
    make = F.when(F.col("_at") % 10 == 0, F.concat(F.lit("  "), column(F.col("p_brand"), 16))).otherwise(F.rpad(F.lit(""), 18, " "))
    tail = F.concat(F.lit("  "), column(F.when(size % 3 == 0, F.concat(F.lit("alt "), size.cast("string"))).otherwise(""), 16), column(F.when(size % 3 == 0, F.concat(F.lit("seen "), "p_type")).otherwise(""), 20), F.when(size % 5 > 0, F.lpad(F.col("p_partkey").cast("string"), 6, "0")).otherwise(""))
    head = F.concat(make, column(F.col("p_name"), 20), column(F.col("p_type"), 14), column(F.concat(size.cast("string"), F.lit(".5")), 10))
    line = F.concat(head, F.lit("u   "), column(F.when(size % 2 == 0, "r,4").otherwise("f"), 6), (1990 + size % 9).cast("string"), F.lit(" "), (2000 + size % 9).cast("string"), tail)
    titles = F.concat(F.lit("  MAKE            MODEL               STYLES        "), F.rpad(F.lit(""), 47, " "), F.lit("REMARKS"))
    printed = rows.select("p_brand", "_file", "_at", F.when(F.col("_at") % 10 == 0, F.concat(F.when(F.col("_at") > 0, "\f").otherwise(""), titles, F.lit("\n"), line)).otherwise(line).alias("line"))
    texts = printed.groupBy(F.concat_ws("-", "p_brand", F.col("_file").cast("string")).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found, _ = layout.vehicle_rows(texts)
    return found.select("make", "model", "styles", "wheelbase", "construction", "drive", "year_start", "year_end", "alt_models", "remarks", "cluster_id")


@query("SELECT upper('1HGCM82633A' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS vin, c_mktsegment[1] || lower(substr(c_mktsegment, 2)) AS make, c_name AS model, CAST(1990 + c_nationkey AS INTEGER) AS year, CASE WHEN c_custkey % 2 = 0 THEN 'EX · AWD' ELSE 'AWD' END AS trim, 'K20 ' || CAST(c_nationkey % 8 + 1 AS VARCHAR) || 'cyl 2.0L' AS engine FROM customer")
def vin_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    answer = F.to_json(F.struct(F.array(F.create_map(
        F.lit("Make"), F.col("c_mktsegment"), F.lit("Model"), F.col("c_name"), F.lit("ModelYear"), (1990 + F.col("c_nationkey")).cast("string"), F.lit("Trim"), F.when(key % 2 == 0, "EX").otherwise(""),
        F.lit("DriveType"), F.lit("AWD"), F.lit("EngineModel"), F.lit("K20"), F.lit("EngineCylinders"), (F.col("c_nationkey") % 8 + 1).cast("string"), F.lit("DisplacementL"), F.lit("2"),
    )).alias("Results")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("1hgcm82633a"), F.lpad(key.cast("string"), 6, "0")).alias("vin"), answer.alias("payload"))
    return vin_fields(rows)

import io
import json
import random
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import inverted, merge, pool, quality, retrieval, shared, submission
from quarry.sources import datasource, documents, layout, seed, sinks, tables, versions
from quarry.streaming import ingest

LAYOUT = """   MAKE      MODEL        STYLES       WB                              ALT MODELS        REMARKS
ACME      Roadster     Coupe        101.2   u   r,4   2001 2005   Spyder            note here     000123
                       Sedan        104.0   f   f     2001 2006                                   000123
 Page 3
OTHER     Van          Wagon        116.0,118.0   u   a   1999 2004   \fBOLT      Truck        Crew         110.5   f   r   1998 2003   Hauler
this line has no form but looks like 1999 2003 a row of it
"""


def test_layout(spark):
    rows, skipped = layout.vehicle_rows(spark.createDataFrame([("a", LAYOUT)], "file string, text string"))
    got = [(r.make, r.model, r.wheelbase, r.drive, r.year_start, r.cluster_id) for r in rows.orderBy("page", "line").collect()]
    assert got == [("ACME", "Roadster", "101.2", "r,4", 2001, "000123"), ("ACME", "Sedan", "104.0", "f", 2001, "000123"), ("OTHER", "Van", "116.0,118.0", "a", 1999, None), ("BOLT", "Truck", "110.5", "r", 1998, None)]
    assert skipped.count() == 1
    stats = layout.parse_stats(rows, skipped, layout.distinct_vehicles(rows)).first()
    assert (stats["raw"], stats["skipped"], stats["unique"], stats["clusters"]) == (4, 1, 4, 1)


def test_spec_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Make,Model,Years,ECU,Parameter,Nominal,Min,Max,Units,State,Page\nAcme,Roadster,2001-2005,SynthMarelli,ECU supply,,1.11,2.22,V,koeo,4\n,,,,Bus,nan,,,ohm,,\n,,,,Resistor,60,,,ohm,key off,x\n")
    good, bad = tables.spec_rows(tables.read_csv(spark, str(tmp_path / "s.csv")), F.lit("s.csv"))
    rows = {r.spec_key: r for r in good.collect()}
    assert set(rows) == {"synthmarelli.ecu_supply_koeo", "resistor_key_off"} and bad.count() == 1
    assert (rows["synthmarelli.ecu_supply_koeo"].vmin, rows["synthmarelli.ecu_supply_koeo"].year_end, rows["resistor_key_off"].page) == (1.11, 2005, None)


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>quantity</t></si><si><t>value</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>supply</t></is></c><c r="C2"><v>5.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert [r.cells for r in tables.read_xlsx(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()] == [["quantity", None, "value"], ["supply", None, "5.5"]]


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = io.BytesIO()
    lines = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{x}</t></is></c>' for j, x in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
    return book.getvalue()


def test_ingest_reads_every_kind_and_reports(spark, tmp_path):
    def told(content):  # an extractor for tests: pages parted by form feeds
        if content.startswith(b"%broken"):
            raise ValueError("no trailer")
        return content.decode().split("\f")

    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "sop.md").write_text("intro\n# CAN bus\nterminate the bus\n## Ground\nground strap\n")
    (docs / "notes.txt").write_text("# not a heading\nword " + "word " * 600)
    (docs / "sub" / "latin.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (docs / "image.png").write_bytes(b"x")
    (docs / "README").write_bytes(b"x")
    (docs / "empty.md").write_text(" \n")
    (docs / "manual.pdf").write_bytes(b"first page\f\fground strap on page three")
    (docs / "bad.pdf").write_bytes(b"%broken")
    (docs / "specs.csv").write_text("Make,Years,ECU,Parameter,Nominal,Min,Max,Units,State\nAcme,2001-2005,SynthMarelli,ECU supply,,1.11,2.22,V,koeo\n,,,,5,,,,\n,,,Bus,60,,,ohm,\n")
    (docs / "sub" / "more.xlsx").write_bytes(workbook([["Quantity", "Value", "Unit"], ["fuel rail", "3.5", "bar"]]))
    (docs / "list.csv").write_text("name,colour\na,b\n")
    (docs / "broken.xlsx").write_bytes(b"no archive")
    files = documents.read_files(spark, str(docs))
    known, report = documents.ingest(files, documents.no_knowledge(spark), told)
    rows = {r.path: r for r in report.collect()}
    assert {p: r.reason for p, r in rows.items() if r.reason} == {
        "image.png": "unsupported type .png", "README": "unsupported type (none)", "empty.md": "no extractable text", "bad.pdf": "unreadable pdf: no trailer",
        "list.csv": tables.NO_SPECS, "broken.xlsx": "unreadable table: File is not a zip file",
    }
    assert (rows["manual.pdf"].pages, rows["manual.pdf"].chunks) == (3, 2) and (rows["sop.md"].pages, rows["sop.md"].chunks) == (1, 3) and rows["notes.txt"].chunks > 3
    assert (rows["specs.csv"].spec_rows, rows["specs.csv"].skipped_rows, rows["specs.csv"].pages) == (2, 1, 0) and rows["sub/more.xlsx"].spec_rows == 1
    assert {r.section for r in known.chunks.filter("path = 'sop.md'").collect()} == {"", "CAN bus", "Ground"}
    assert known.chunks.filter("path = 'sub/latin.txt'").first().text == "caf\ufffd au lait" and known.chunks.agg(F.max(F.length("text"))).first()[0] <= 800
    assert known.chunks.filter("path = 'manual.pdf'").agg(F.max("page")).first()[0] == 3
    specs = {r.spec_key: r for r in known.specs.collect()}
    assert set(specs) == {"synthmarelli.ecu_supply_koeo", "bus", "fuel_rail"} and specs["fuel_rail"].source_file == "more.xlsx" and specs["synthmarelli.ecu_supply_koeo"].year_end == 2005
    found = retrieval.bm25(spark.createDataFrame([(0, "CAN bus"), (1, "ground strap")], "query_id long, query string"), known.chunks.withColumn("key", F.concat_ws("|", "path", "page", "section")), "key", ["text", "section"], k=1, stem=True).collect()
    assert {r.query_id: r.key.split("|")[0] for r in found}[0] == "sop.md"

    again, report = documents.ingest(documents.read_files(spark, str(docs)), known, told)
    assert {r.reason for r in report.collect()} >= {"unchanged"} and report.filter("reason is null").count() == 0
    assert [x.count() for x in again] == [x.count() for x in known]
    (docs / "sop.md").write_text("only this\n")
    (docs / "specs.csv").write_text("quantity,value\nbus,120\n")
    (docs / "notes.txt").unlink()
    third, report = documents.ingest(documents.read_files(spark, str(docs)), again, told)
    assert sorted(r.path for r in report.filter("reason is null").collect()) == ["sop.md", "specs.csv"]
    assert [r.text for r in third.chunks.filter("path = 'sop.md'").collect()] == ["only this"] and third.chunks.filter("path = 'notes.txt'").count() > 3
    assert [(r.spec_key, r.value) for r in third.specs.filter("path = 'specs.csv'").collect()] == [("bus", 120.0)]
    pruned, _ = documents.ingest(documents.read_files(spark, str(docs)), again, told, prune=True)
    assert pruned.chunks.filter("path = 'notes.txt'").count() == 0 and pruned.files.filter("path = 'notes.txt'").count() == 0
    nowhere = documents.ingest(documents.read_files(spark, str(docs / "none")), third, told)
    assert [r.reason for r in nowhere[1].collect()] == ["not a directory"] and nowhere[0].chunks.count() == third.chunks.count()


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    assert versions.tables(spark, root) == {}
    versions.commit(spark, root, {"a": spark.range(3), "b": spark.range(1)})
    before = versions.read(spark, root, "a")
    versions.commit(spark, root, {"a": spark.range(5)})
    assert (before.count(), versions.read(spark, root, "a").count(), versions.read(spark, root, "b").count()) == (3, 5, 1)
    spark.range(9).write.parquet(f"{root}/9999999999999-unfinished/a")  # a writer that never finished
    assert versions.read(spark, root, "a").count() == 5


def test_seed_validate_is_idempotent(spark):
    cars, groups, edges = seed.as_tables(seed.seed_vehicles(spark))
    log = spark.createDataFrame([], "date string, part string, method string, cluster_id string, result string, notes string")
    members, verdicts = quality.validate(cars, groups, edges, log, F.lit("2024-01-01"))
    assert verdicts.count() == 110 and members.filter("confidence = 'edc-flagged'").count() == 220
    members, verdicts = quality.validate(cars, groups, members, verdicts, F.lit("2024-01-02"))
    assert verdicts.count() == 110 and members.filter("confidence = 'edc-flagged'").count() == 220


def test_overlay_is_idempotent(spark):
    cars = spark.createDataFrame([(1, "Acme", "Roadster", 2000, 2005, "EDC")], "id long, make string, model string, year_start int, year_end int, source string")
    groups = spark.createDataFrame([("c1", "structural", "x", "EDC")], "cluster_id string, type string, label string, source string")
    edges = spark.createDataFrame([(1, "c1", "structural", "edc", "")], "vehicle_id long, cluster_id string, scope string, confidence string, note string")
    new_cars = spark.createDataFrame([(0, "Acme", "Coupe", 2010, 2012, "p1:base", "e1:big;lost:x")], "ord int, make string, model string, year_start int, year_end int, platform string, engines string")
    new_groups = spark.createDataFrame([("p1", "structural", "P"), ("e1", "engine_family", "E")], "cluster_id string, type string, label string")
    rules = spark.createDataFrame([(1, "e1", "Acme", "road%", 2004, 2006, "rule")], "rule_id int, cluster_id string, make string, model_like string, year_from int, year_to int, note string")
    once = pool.apply_overlay(cars, groups, edges, new_cars, new_groups, rules)
    twice = pool.apply_overlay(*once, new_cars, new_groups, rules)
    for a, b in zip(once, twice):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    assert {(r.vehicle_id, r.cluster_id) for r in once[2].collect()} == {(1, "c1"), (900001, "p1"), (900001, "e1"), (1, "e1")}


def test_bm25_equals_an_fts_index(spark):
    texts = ["The battery cranks slowly", "cranking voltage and crank sensor, crank again", "ground strap résumé of the battery", "nothing here", "voltage voltage voltage battery"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, text) VALUES(?, ?)", list(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for k, q in enumerate(["cranking battery", "crank cranking", "voltages", "resume", "zzz"]):
        terms = " OR ".join(f'"{t}"' for t in dict.fromkeys(q.split()))
        want = con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (terms,)).fetchall()
        got = retrieval.bm25(spark.createDataFrame([(k, q)], "query_id long, query string"), rows, "id", "text", k=None, stem=True).collect()
        assert {r["id"]: round(r["score"], 6) for r in got} == {i: round(s, 6) for i, s in want}, q


def test_windows_overlap():
    """Several texts at once: windows never reach into the next text, overlap, end at spaces, and hold every word."""
    texts = ["word " * 600, " a \n b ", "  ", "x" * 2000, " ".join(f"w{i}" for i in range(900)), "é " * 401]
    found = retrieval.windows(texts)
    assert found[1] == ["a b"] and found[2] == [] and found[3] == ["x" * 800, "x" * 800, "x" * 600]
    assert len(found[0]) > 3 and all(len(p) <= 800 for own in found for p in own)
    for text, own in zip(texts, found):
        assert set(text.split()) <= {w for p in own for w in p.split()} or "x" * 2000 in text
        assert all(b[:50] in a or len(b) < 50 for a, b in zip(own, own[1:]))
    assert all(found[i] == retrieval.windows([t])[0] for i, t in enumerate(texts)) and retrieval.windows([]) == []


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 2)], "k int, v string, ord int")
    assert sorted(map(tuple, merge.insert_or_ignore(old, new, ["k"], ["ord"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, merge.insert_or_replace(old, new, ["k"], [F.desc("ord")]).collect())) == [(1, "a"), (2, "x"), (3, "z")]
    assert sorted(r.id for r in merge.numbered(spark.range(50).withColumnRenamed("id", "x"), ["x"]).collect()) == list(range(1, 51))


def test_vin_fields(spark):
    rows = spark.createDataFrame([("1hgcm82633a004352", '{"Results":[{"Make":"HONDA","Model":"Accord","ModelYear":"2003","Trim":"EX","DriveType":"","EngineCylinders":"6","DisplacementL":"3"}]}'), ("bad", "{}")], "vin string, payload string")
    got = [tuple(r) for r in sinks.vin_fields(rows).collect()]
    assert got == [("1HGCM82633A004352", "Honda", "Accord", 2003, "EX", "6cyl 3.0L")]


def test_bundle():
    assert sinks.bundle("<script>__DATA__</script>", {"__DATA__": {"a": "</script>"}}) == '<script>{"a":"<\\/script>"}</script>'


def test_known_pools(spark):
    cars = seed.known_vehicles(spark).unionByName(seed.seed_vehicles(spark))
    assert (cars.count(), cars.select("cluster_id").distinct().count()) == (1885, 973)
    tables_ = seed.as_tables(cars)
    found = lambda make, model, year: {(r.make, r.model) for r in pool.donor_pool(*tables_, make, model, year).collect()}
    assert found("chevrolet", "tahoe", 2010) == {("GMC", "Yukon"), ("Cadillac", "Escalade")}
    assert found("Subaru", "BRZ", 2013) == {("Scion", "FR-S")} and found("Acura", "RL", 2009) == set()
    assert found("BMW", "528i", 2008) == {("BMW", "525,530"), ("BMW", "M5")}


def test_pack_files(spark, tmp_path):
    from quarry.operators import packs
    from quarry.plans.gates import PACK, gate

    LOST = {**PACK, "id": "lost", "gates": [*PACK["gates"], gate("ALONE", "boolean", {"YES": "VIEW", "NO": "TERMINAL-STOP"})]}
    for name, pack in (("b", PACK), ("a", LOST)):
        (tmp_path / f"{name}.json").write_text(json.dumps(pack, indent=1))
    rows = packs.read_packs(spark, str(tmp_path))
    assert [r.id for r in rows.collect()] == ["lost", "events_pack"]
    assert [(r.pack, r.gate) for r in packs.problems(rows).collect()] == [("lost", "ALONE")]
    loop = {**PACK, "gates": [{**g, "next": {k: "VIEW" for k in g["next"]}} if g["id"] == "ERROR" else g for g in PACK["gates"]]}
    cyclic = spark.createDataFrame([(json.dumps(loop),)], "v string").select(F.from_json("v", packs.PACK_SCHEMA).alias("p")).select("p.*")
    assert {r.gate for r in packs.problems(cyclic).filter("problem like '%cycle%'").collect()} == {"VIEW", "CLICK", "ERROR"}


def test_numbered_keeps_other_columns_and_gives_each_id_once(spark):
    """400,000 rows in 8 ranges, with ties in the order, other columns and a map."""
    rows = spark.range(400_000).select((F.col("id") * 7919 % 50_021).alias("k"), F.col("id").alias("own"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.create_map(F.lit("a"), "id").alias("m"))
    folder = shared.shared_dir(spark, "numbered-test")
    merge.numbered(rows, ["k"], column="n").write.parquet(f"{folder}/t")
    got = spark.read.parquet(f"{folder}/t")
    facts = got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("own")).first()
    assert tuple(facts) == (400_000, 400_000, 1, 400_000, 400_000)
    wrong = got.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("own"))).withColumn("low", F.min("n").over(Window.partitionBy("k"))).filter("n - low + 1 <> want")
    assert wrong.count() == 0
    assert merge.numbered(rows.limit(0), ["k"]).count() == 0


def test_a_cluster_needs_a_named_folder():
    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


def test_documents_of_json(spark, tmp_path):
    """Files that make one JSON document when read behind each other: an export, a compact catalogue, an index of job files."""
    rows = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("id"), F.concat(F.lit('a "quoted" é '), "id").alias("make"))

    def read(path):
        return json.loads("".join(p.read_text() for p in sorted((tmp_path / path).glob("part-*.txt"))))

    sinks.export_document(rows, ["id", "make"], ["id"], f"{tmp_path}/flat", "2024-01-01T00:00:00Z")
    got = read("flat")
    assert got["row_count"] == 1000 and got["generated_at"] == "2024-01-01T00:00:00Z" and got["rows"] == [[i, f'a "quoted" é {1000 - i}'] for i in range(1, 1001)]
    sinks.export_document(rows.limit(0), ["id", "make"], ["id"], f"{tmp_path}/none", "now")
    assert read("none") == {"generated_at": "now", "row_count": 0, "rows": []}
    groups = spark.createDataFrame([("c1", "structural", None), ("c2", "engine_family", "x")], "cluster_id string, type string, label string")
    sinks.compact(rows, groups, rows.select("id"), f"{tmp_path}/compact")
    got = read("compact")
    assert len(got["v"]) == 1000 and len(got["m"]) == 1000 and got["c"] == {"c1": ["structural", None], "c2": ["engine_family", "x"]}
    jobs_done = spark.createDataFrame([("C 2", "s", "Job B", "m", "text b", "t2"), ("C 1", "s", "Job A", "m", "text a", "t1")], "cluster_id string, scope string, job string, model string, content string, created_at string")
    sinks.write_job_files(jobs_done, f"{tmp_path}/sops")
    assert (tmp_path / "sops" / "c_1" / "job_a.md").read_text() == "# C 1: Job A\n\ntext a\n"
    assert [(r["cluster_id"], r["path"]) for r in read("sops/index")] == [("C 1", "c_1/job_a.md"), ("C 2", "c_2/job_b.md")]


def test_validation_refuses_duplicates(spark):
    cars, groups, edges = seed.as_tables(seed.seed_vehicles(spark))
    log = spark.createDataFrame([], "date string, part string, method string, cluster_id string, result string, notes string")
    assert tuple(quality.summary(groups, *quality.validate(cars, groups, edges, log, F.lit("2024-01-01"))).first()) == (969, 110, 110)
    with pytest.raises(ValueError, match="1 combinations"):
        quality.validate(cars, groups, edges.union(edges.limit(1)), log, F.lit("2024-01-01"))


def test_curated_tier_is_replaced(spark):
    edges = spark.createDataFrame([(1, "c1", "structural", "edc", ""), (2, "c1", "structural", "curated", "old")], "vehicle_id long, cluster_id string, scope string, confidence string, note string")
    new = spark.createDataFrame([(3, "c1", "platform", "new"), (4, "c2", "platform", "new")], "vehicle_id long, cluster_id string, scope string, note string")
    once, n = pool.apply_curated(edges, new)
    twice, again = pool.apply_curated(once, new)
    assert n == again == 2 and sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert sorted(r.vehicle_id for r in once.collect()) == [1, 3, 4]


def test_rerank_prefers_mentions(spark):
    found = spark.createDataFrame([(0, 1, -3.0), (0, 2, -2.0), (0, 3, -1.0)], "query_id long, id long, score double")
    texts = spark.createDataFrame([(1, "bus"), (2, "Acme bus"), (3, "bus acme")], "id long, text string")
    got = retrieval.rerank(found, texts, "id", F.lower("text").contains("acme"), 2)
    assert [(r["id"], r.place) for r in got.orderBy("place").collect()] == [(2, 1), (3, 2)]


def test_helper_columns_meet_no_columns_of_the_input(spark):
    """Every name that the helpers use themselves, as a column of the input: kept, with its values."""
    names = ["_part", "_at", "_base", "_own", "_first", "_n", "_by0", "_next", "_place_", "a b", "x.y"]
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), *((F.col("id") * 2).alias(c) for c in names))
    told = {tuple(r[c] for c in names) for r in rows.collect()}
    for found in (merge.numbered(rows, [F.desc("k")], column="n"), merge.placed(rows, ["k"], "at"), merge.stride_sample(rows, ["g"], ["k"], 5), pool.keep_first(rows, ["k"], ["g"])):
        assert {tuple(r[c] for c in names) for r in found.collect()} <= told and set(rows.columns) <= set(found.columns)
    assert {r.n: r.k for r in merge.numbered(rows, [F.desc("k")], column="n").collect()} == {i + 1: 59 - i for i in range(60)}
    assert sorted(r["x.y"] for r in merge.numbered(rows, ["x.y"], column="n").filter("n <= 2").collect()) == [0, 2]
    with pytest.raises(ValueError, match="already"):
        merge.numbered(rows, ["k"], column="G")
    named = rows.withColumnRenamed("_first", "_place")
    assert merge.stride_sample(named, ["g"], ["k"], 5).columns == named.columns and pool.keep_first(named, ["g"], ["k"]).columns == named.columns
    labels = rows.select("g", F.col("k").cast("string").alias("_at"), F.col("k").alias("_place"))
    assert [r.labels for r in merge.first_labels(labels, ["g"], "_at", "_place", 2).orderBy("g").collect()] == [["0", "3"], ["1", "4"], ["2", "5"]]


def test_a_version_that_is_being_written_hides_nothing(spark, tmp_path):
    root = str(tmp_path / "v")
    versions.commit(spark, root, {"a": spark.range(3)})
    for half in ("9999999999999-x/_TABLES.new", "9999999999999-y"):
        (tmp_path / "v" / half).mkdir(parents=True)
    assert versions.read(spark, root, "a").count() == 3


def told_by(found, key):
    return {(r.query_id, r[key]): (round(r.score, 6), r.place) for r in found.collect()}


def test_a_kept_index_answers_as_a_search_of_the_live_rows(spark, tmp_path):
    words = ["grounds", "grounding", "battery", "batteries", "fuse", "relay", "wire"]
    rng = random.Random(3)
    row = lambda f, i: (f, f"{f}#{i}", " ".join(rng.choices(words, k=rng.randint(1, 9))))
    schema = "path string, chunk string, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    live = {f: [row(f, i) for i in range(rng.randint(1, 4))] for f in "abcdefgh"}
    queries = spark.createDataFrame([(0, "ground battery"), (1, "fuses and relays"), (2, "nothing here"), (3, "the")], "query_id long, query string")
    root = str(tmp_path / "index")
    assert inverted.search(queries, root).count() == 0

    def check():
        own = frame([r for rows in live.values() for r in rows])
        want = told_by(retrieval.bm25(queries, own, "chunk", "text", stem=True), "chunk")
        assert told_by(inverted.search(queries, root), "row") == want and (want or not live)

    assert inverted.add(frame([r for rows in live.values() for r in rows]), root, "path", "chunk", "text", stem=True) == 1
    check()
    for f in "bd":
        live[f] = [row(f, i) for i in range(2)]
    del live["h"]
    inverted.add(frame(live["b"] + live["d"]), root, "path", "chunk", "text", gone=frame([("h", None, None), ("never", None, None)]), stem=True)
    check()
    live["h"] = [row("h", 0)]  # a file that is back
    inverted.add(frame(live["h"]), root, "path", "chunk", "text", stem=True, number=7)
    check()
    inverted.add(frame([row("a", 9)]), root, "path", "chunk", "text", stem=True, number=7)  # counts already
    check()
    (tmp_path / "index/postings/segment=8/bucket=1").mkdir(parents=True)  # a run that broke
    (tmp_path / "index/done/.8").write_text("{")
    check()
    assert inverted.merge(spark, root) == 8 and list(inverted.segments(spark, root)) == [8] and inverted.merge(spark, root) is None
    check()
    inverted.vacuum(spark, root)
    assert sorted(p.name for p in (tmp_path / "index/postings").iterdir()) == ["segment=8"]
    check()
    with pytest.raises(ValueError):
        inverted.add(frame(live["b"]), root, "path", "chunk", "text", stem=False)


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("row"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    inverted.add(rows, root, "row", "row", "text")
    asked = spark.createDataFrame([("word17",), ("word900",)], "term string")
    found = inverted.postings_of(spark, root, asked)
    assert sorted(r.row for r in found.collect()) == ["17", "900"]
    own = sorted(r[0] for r in asked.select(inverted._bucket("term")).collect())
    filters = re.findall(r"PartitionFilters: \[([^\]]*)", found._jdf.queryExecution().toString())
    assert len(own) == 2 and any(all(str(b) in f for b in own) and f.startswith("bucket") for f in filters), filters


def test_ingest_keeps_an_index(spark, tmp_path):
    root = str(tmp_path / "index")
    questions = spark.createDataFrame([(0, "ground strap")], "query_id long, query string")

    def ingest(files, known):
        rows = documents.with_reasons(spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary"))
        return documents.ingest(rows, known, prune=True, index=root)[0]

    known = ingest({"a.md": "# Earth\nThe ground strap.", "b.txt": "Fuse seven.", "c.txt": "Ground it."}, documents.no_knowledge(spark))
    hits = lambda: sorted(r.row.split("\n")[0] for r in inverted.search(questions, root).collect())
    assert hits() == ["a.md", "c.txt"]
    known = ingest({"a.md": "# Earth\nNothing.", "b.txt": "Fuse and ground straps."}, known)
    assert hits() == ["b.txt"] and known.chunks.count() == 2


def files_at(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())


def test_data_source_reads_what_read_files_reads(spark, tmp_path):
    files_at(tmp_path, {"a.md": "# A\nx", "sub/b.TXT": "é", "sub/deep/c": "none", "d.png": "", "e.tar.gz": "z", ".hidden": "h"} | {f"many/{i}.txt": "w" * i for i in range(40)})
    datasource.register(spark)
    own = {tuple(r) for r in spark.read.format("quarry-docs").option("partitionBytes", 200).load(str(tmp_path)).select("path", "suffix", "sha256", F.col("content").cast("string"), "reason").collect()}
    other = {tuple(r) for r in documents.read_files(spark, str(tmp_path)).select("path", "suffix", "sha256", F.col("content").cast("string"), "reason").collect()}
    assert {r for r in own if not r[0].startswith(".") and r[3]} == other and len(own) == 46
    assert [tuple(r) for r in spark.read.format("quarry-docs").load(str(tmp_path / "none")).collect()] == [(str(tmp_path / "none"), "", "", None, "not a directory")]


def test_data_source_opens_only_files_that_are_asked_for(spark, tmp_path, monkeypatch):
    files_at(tmp_path, {f"{d}/{i}.{s}": "text" for d in "ab" for i in range(5) for s in ("md", "txt", "csv")})
    datasource.register(spark)
    source = lambda **o: spark.read.format("quarry-docs").options(**o).load(str(tmp_path))
    conditions = [("suffix = 'md'", 10), ("suffix IN ('md', 'csv') AND path LIKE 'a/%'", 10), ("path = 'b/3.txt'", 1), ("path LIKE '%.csv' AND length(content) > 3", 10), ("suffix = 'md' OR path = 'a/0.txt'", 11), ("true", 30)]
    rows = source()
    for condition, n in conditions:
        assert rows.filter(condition).count() == n and source(pushFilters="true").filter(condition).count() == n
    assert source(prefix="a/", suffixes="md, TXT").count() == 10 and source(suffixes="png").count() == 0
    opened = []
    group = datasource.read_group
    monkeypatch.setattr(datasource, "read_group", lambda root, paths: (opened.extend(paths), group(root, paths))[1])
    reader = datasource.PushingReader(str(tmp_path), 3, [])
    left = list(reader.pushFilters([datasource.EqualTo(("suffix",), "md"), datasource.StringStartsWith(("path",), "b/"), datasource.EqualTo(("sha256",), "x")]))
    assert [f.attribute for f in left] == [("sha256",)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(opened) == [f"b/{i}.md" for i in range(5)] and len(rows) == 5 and len(reader.partitions()) == 5


def test_streams_of_files_bring_each_change_once(spark, tmp_path):
    docs, out, state = tmp_path / "docs", str(tmp_path / "out"), str(tmp_path / "state")
    datasource.register(spark)

    def arrive(files, **how):
        files_at(docs, files)
        stream = spark.readStream.format("quarry-docs").load(str(docs))
        ingest.ingest_stream(stream, out, state, **how).awaitTermination()

    arrive({"a.md": "# Earth\nThe ground strap.", "b.txt": "Fuse seven.", "c.png": "?"})
    arrive({"b.txt": "Fuse eight.", "d.txt": "Ground it."})
    arrive({})
    kept = ingest.knowledge(spark, out)
    assert sorted((r.path, r.text) for r in kept.chunks.collect()) == [("a.md", "The ground strap."), ("b.txt", "Fuse eight."), ("d.txt", "Ground it.")]
    assert sorted((r.segment, r.path, r.reason) for r in ingest.reports(spark, out).collect()) == [(0, "a.md", None), (0, "b.txt", None), (0, "c.png", "unsupported type .png"), (1, "b.txt", None), (1, "d.txt", None)]
    asked = spark.createDataFrame([(0, "ground"), (1, "seven eight")], "query_id long, query string")
    assert sorted((r.query_id, r.row.split("\n")[0]) for r in inverted.search(asked, f"{out}/index").collect()) == [(0, "a.md"), (0, "d.txt"), (1, "b.txt")]


def test_a_batch_that_breaks_is_run_again_and_counts_once(spark, tmp_path, monkeypatch):
    """Broken behind any of its writes, and run again by a restart: the same tables as without the break."""
    files = {"a.md": "# Earth\nThe ground strap.", "b.txt": "Fuse seven.", "t.csv": "Parameter,Nominal,Units\nsupply,5,V\n"}
    files_at(tmp_path / "docs", files)
    datasource.register(spark)

    def run(name):
        stream = spark.readStream.format("quarry-docs").load(str(tmp_path / "docs"))
        ingest.ingest_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()

    run("whole")
    for point in ("inverted.add", "_path"):
        with monkeypatch.context() as m:

            def broken(*a, own=inverted.add, **k):
                if point == "inverted.add":
                    raise RuntimeError("lost")
                return own(*a, **k)

            m.setattr(ingest.inverted, "add", broken)
            if point == "_path":
                real = ingest._path
                m.setattr(ingest, "_path", lambda s, n: (_ for _ in ()).throw(RuntimeError("lost")) if "/done/." in n and "index" not in n else real(s, n))
            with pytest.raises(Exception, match="lost"):
                run(f"broken-{point}")
            assert ingest.knowledge(spark, str(tmp_path / f"broken-{point}")).chunks.count() == 0
        run(f"broken-{point}")
        for own, other in zip(ingest.knowledge(spark, str(tmp_path / "whole")), ingest.knowledge(spark, str(tmp_path / f"broken-{point}"))):
            assert sorted(map(str, own.collect())) == sorted(map(str, other.collect())) != []
        assert list(inverted.segments(spark, str(tmp_path / f"broken-{point}/index"))) == [1]


def test_a_tier_is_reloaded_without_touching_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "edc"), (2, "curated"), (3, "x y/z"), (4, "over")], "k long, tier string").write.partitionBy("tier").parquet(path)
    names = lambda: {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    before = names()
    merge.reload_tiers(spark.createDataFrame([(5, "curated"), (6, "curated")], "k long, tier string"), path, "tier", ["curated", "x y/z"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "edc"), (4, "over"), (5, "curated"), (6, "curated")]
    kept = {n for n in before if "tier=edc" in n or "tier=over" in n}
    assert kept <= names() and len(kept) == 2
    with pytest.raises(ValueError, match="other tiers"):
        merge.reload_tiers(spark.createDataFrame([(5, "edc")], "k long, tier string"), path, "tier", ["curated"])
    merge.reload_tiers(spark.createDataFrame([], "k long, tier string"), path, "tier", ["curated"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 4]


@pytest.mark.parametrize("block", [4096, 3])
def test_batches_keep_both_bounds_and_nothing_is_sent_twice(spark, monkeypatch, block):
    monkeypatch.setattr(submission, "BLOCK", block)
    rng = random.Random(5)
    rows = [(f"c{i}", i, "é" * rng.choice([1, 3, 10, 30])) for i in range(120)] + [("big", 500, "x" * 95), ("full", 501, "x" * 100)]
    targets = spark.createDataFrame(rows, "custom_id string, k long, value string")
    found = submission.cut(targets, ["k"], 9, 100, first=4).collect()
    assert sorted(r.custom_id for r in found) == sorted(r[0] for r in rows)
    batches = {}
    for r in found:
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(4, 4 + len(batches)))
    for own in batches.values():
        assert len(own) <= 9 and sum(len(r.value.encode()) for r in own) <= 100
    small = sorted((r.k, r.batch) for r in found if len(r.value.encode()) <= 50)
    assert [b for _, b in small] == sorted(b for _, b in small) and len(batches) < 70
    with pytest.raises(ValueError, match="larger"):
        submission.cut(targets, ["k"], 9, 99)
    assert submission.cut(targets.limit(0), ["k"], 9, 100).count() == 0

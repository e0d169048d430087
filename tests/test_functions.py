import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import audit, collate, extraction, gates, matching, sql, stemming, text
from quarry.operators import retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "asked, row, separators, expected",
    [
        ("528i", "528,535,550", False, True), ("528i", "525,530", False, False), ("Tahoe", "tahoe", False, True), ("", "x", False, False), ("x", "", False, False),
        ("328i", "3-series", False, True), ("3-Series", "3 Series", True, True), ("3-Series", "3 Series", False, False), ("330i", "3 Series", True, True), ("", "anything", True, True), ("F-150", "F 150", True, True), ("M3", "3 series", True, False),
    ],
)
def test_model_matches(spark, asked, row, separators, expected):
    assert one(spark, matching.model_matches(F.lit(asked), F.lit(row), separators)) is expected


@pytest.mark.parametrize("raw, expected", [("Mercedes-Benz", "mercedes"), (" VW ", "volkswagen"), ("BMW", "bmw")])
def test_norm_make(spark, raw, expected):
    assert one(spark, matching.norm_make(F.lit(raw))) == expected


@pytest.mark.parametrize("raw, expected", [("3-Series", "3 series"), ("F-150", "f 150"), (" a__b ", "a b")])
def test_norm_model(spark, raw, expected):
    assert one(spark, matching.norm_model(F.lit(raw))) == expected


def test_parse_subject(spark):
    assert tuple(one(spark, matching.parse_subject(F.lit(" 2008 BMW 528i touring ")))) == (2008, "BMW", "528i touring")
    assert one(spark, matching.parse_subject(F.lit("BMW 528i"))) is None


def test_keys_and_years(spark):
    assert one(spark, text.spec_key(F.lit("Marelli"), F.lit("ECU supply"), F.lit("KOEO"))) == "marelli.ecu_supply_koeo"
    assert one(spark, text.spec_key(F.lit(""), F.lit("ECU supply"), F.lit(""))) == "ecu_supply"
    assert tuple(one(spark, F.struct(*text.year_range(F.lit("2001–2005"))))) == (2001, 2005)
    assert tuple(one(spark, F.struct(*text.year_range(F.lit("2003"))))) == (2003, 2003)
    assert tuple(one(spark, F.struct(*text.year_range(F.lit("soon"))))) == (None, None)


@pytest.mark.parametrize("x", [0.0, 1.5, 12.0, 0.1 + 0.2, 1234567.0, 1.25e-5, -3.75, 100000.0, 999999.5])
def test_general_number(spark, x):
    assert one(spark, text.general_number(F.lit(x))) == f"{x:g}"


def test_general_numbers_of_all_sizes(spark):
    """As %g has them, from the smallest to the largest, and what is no number; in the plan no formatter and no pattern."""
    rng = random.Random(4)
    found = [0.0, -0.0, float("inf"), -float("inf"), float("nan"), 5e-324, -2.5e-310, 1.7976931348623157e308, 999999.5, 9999995.0, 1234565.0, 1e-4, 9.9999996e-5, -123456.4, 0.1 + 0.7]
    found += [s * 10.0**k for k in range(-323, 309) for s in (1, -1)] + [math.nextafter(10.0**k, to) for k in range(-300, 308) for to in (0.0, math.inf)]
    found += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-7, 9) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in [*found, None]], "x double").select("x", text.general_number("x").alias("g"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and "regexp" not in plan
    assert [(r.x, r.g) for r in rows.collect() if r.x is None or r.g != f"{r.x:g}"] == [(None, None)]


def test_tags(spark):
    assert [tuple(t) for t in one(spark, text.tags(F.lit("a: n1 ; b;;c:x:y")))] == [("a", "n1"), ("b", ""), ("c", "x:y")]


@pytest.mark.parametrize(
    "kind, op, value, low, high, reading, expected",
    [
        ("threshold", ">=", 5.0, None, None, 5.0, "PASS"), ("threshold", ">", 5.0, None, None, 5.0, "FAIL"), ("threshold", "<=", None, None, 3.0, 3.0, "PASS"), ("threshold", "<", None, 1.0, None, 0.0, None),
        ("window", None, None, 1.0, 2.0, 1.0, "PASS"), ("window", None, None, 1.0, 2.0, 0.9, "LOW"), ("window", None, None, 1.0, 2.0, 2.1, "HIGH"), ("window", None, 1.0, None, 2.0, 1.5, None),
    ],
)
def test_evaluate(spark, kind, op, value, low, high, reading, expected):
    number = lambda x: F.lit(x).cast("double")
    got = one(spark, gates.evaluate(F.lit(kind), F.lit(op), number(reading), F.lit(None).cast("boolean"), number(value), number(low), number(high)))
    assert got == expected


def test_tokens(spark):
    for kind, gate, outcome in [("INTAKE", "", ""), ("GATE", "BATT", "PASS"), ("HALT", "", ""), ("RISK-ACK", "A_1", ""), ("PENDING", "ECU", ""), ("TERMINAL", "DONE", "")]:
        line = F.concat(F.lit("COMMIT: "), gates.token(F.lit(kind), F.lit(gate), F.lit(outcome)))
        assert tuple(one(spark, gates.parse_token(line))) == (kind, gate, outcome)
    assert one(spark, gates.parse_token(F.lit("COMMIT: DEV-BRANCH-GATE-A-MAYBE"))) is None


@pytest.mark.parametrize(
    "message, expected",
    [
        ("battery reads 12.4 V cranking", [(12.4, "V", "CRANKING")]), ("got 0.3 ohms; key off", [(0.3, "ohm", None)]), ("my 2008 528i stalled 3 times", []), ("it is 5", [(5.0, None, None)]),
        ("P0335 and 11.9 volts", [(11.9, "V", None)]), ("after a very long day in the shop the car has 4 doors", []),
    ],
)
def test_readings(spark, message, expected):
    rows = spark.createDataFrame([(message,)], "t string").select(extraction.readings("t").alias("r")).first()["r"]
    assert [(r["value"], r["unit"], r["state"]) for r in rows] == expected


def test_subject(spark):
    rows = spark.createDataFrame([("2008 BMW 528i with a miss",), ("no year",), ("2000 ohms",), ("the Honda Civic 2012",)], "t string").select(extraction.subject("t").alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [("BMW", "528i", 2008), (None, None, None), (None, None, None), ("Honda", "Civic", 2012)]


def test_codes(spark):
    assert one(spark, extraction.trouble_codes(F.lit("p0335, P0335 and U0100 xP0001"))) == ["P0335", "U0100"]


def test_audit(spark):
    allowed = F.array(F.lit("12.4 V [manual.pdf p.2]"), F.lit("step 3"))
    assert one(spark, audit.offending(F.lit("1. Measured 12.40 [manual.pdf p.2]\nCOMMIT: X-99"), allowed)) == []
    assert one(spark, audit.offending(F.lit("It is 13 or twelve volts [other.pdf p.9]"), allowed)) == ["13", "twelve volts", "[other.pdf p.9]"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("electriciti", "electr"), ("adoption", "adopt"), ("controll", "control"), ("cranking", "crank")])
def test_porter(word, stem):
    assert stemming.porter(word) == stem


def test_guard(spark):
    allowed = F.array(F.lit("12.4 V"))
    cases = {"COMMIT: X\nMeasure it. Is it 12.4?": "Measure it. Is it 12.4?", "Why? How?": None, "It passed.": None, "It is 13.": None, "SAFEGUARD: x": None}
    for body, want in cases.items():
        assert one(spark, audit.guarded(F.lit(body), allowed)) == want
    assert one(spark, audit.guarded(F.lit("fine"), allowed, F.lit(True))) is None


def test_merge_extracted(spark):
    own = F.array(F.struct(F.lit(1.0).alias("value"), F.lit("V").alias("unit"), F.lit(None).cast("string").alias("state"), F.lit("c").alias("clause")))
    merge = lambda answer: one(spark, extraction.merge_extracted(own, F.array(F.lit("P0001")), F.lit(None).cast("boolean"), F.lit(answer), F.lit("while cranking")))
    got = merge('{"readings":[{"value":"2.5","unit":"null","state":"ODD"},{"value":"x"},{"unit":"V"}],"dtcs":["p0001","u0100"],"yes_no":true}')
    assert [(r.value, r.unit, r.state) for r in got.readings] == [(1.0, "V", None), (2.5, None, "CRANKING")] and got.codes == ["P0001", "U0100"] and got.yes_no is True
    assert len(merge("no json").readings) == 1


def test_sql_functions_are_the_column_expressions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("A-b  C_d", "q 1", "", 1234567.0), (None, None, None, None), ("Mercedes-Benz ", "é", "KOEO", 0.1)], "x string, q string, s string, n double")
    found = spark.sql("SELECT slug(x), norm_make(x), norm_model(x), spec_key(x, q, s), general_number(n) FROM {rows}", rows=rows)
    want = rows.select(text.slug("x"), matching.norm_make("x"), matching.norm_model("x"), text.spec_key("x", "q", "s"), text.general_number("n"))
    assert list(map(tuple, found.collect())) == list(map(tuple, want.collect()))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_as_a_table_function(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(0, "word " * 600), (1, ""), (2, None), (3, " one  two ")], "k int, t string")
    found = spark.sql("SELECT k, place, c.text FROM {rows}, LATERAL chunk_text(t) c", rows=rows).collect()
    want = retrieval.chunks(rows, "t").select("k", "ord", "t").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(found) > 4
    short = spark.sql("SELECT * FROM chunk_text('aaa bbb ccc ddd', 7, 2)").collect()
    assert [len(r.text) <= 7 for r in short] == [True] * len(short) and short[0].text == "aaa" and short[-1].text.endswith("ddd")
    for wrong in ("chunk_text(5)", "chunk_text('a', 5, 5)", "chunk_text('a', 'b')"):
        with pytest.raises(Exception, match="chunk_text|size and overlap"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_collations(spark):
    rows = spark.createDataFrame([("Straße", "STRASSE"), ("École", "ecole"), ("İ", "i"), (None, "x"), ("Σίσυφος", "ΣΊΣΥΦΟΣ")], "a string, b string")
    got = rows.select((collate.folded("a") == collate.folded("b")).alias("folded"), (collate.plain("a") == collate.plain("b")).alias("plain")).collect()
    assert list(map(tuple, got)) == [(True, True), (False, True), (False, True), (None, None), (True, True)]
    words = ["z", "Ä", "a", "ä", "A", "o", "ö"]
    order = lambda locale: [r.w for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy(collate.ordered("w", locale)).collect()]
    assert order("de") == ["a", "A", "ä", "Ä", "o", "ö", "z"] and order("sv") == ["a", "A", "o", "z", "ä", "Ä", "ö"]


def test_open_answers(spark):
    answers = ['{"readings":[{"value":1.25,"unit":"V"},{"value":"x"},null]}', "{", None, "[]", "7", '{"readings":{"value":1}}', '{"result":{"readings":[3]}}', ""]
    rows = spark.createDataFrame(list(enumerate(answers)), "k int, a string").select("k", extraction.open_answer("a").alias("o"))
    got = {r.k: (r.form, r.v, r.t) for r in rows.select("k", "o.form", F.col("o.readings.value").alias("v"), F.col("o.readings.text").alias("t")).collect()}
    assert got[0][:2] == ("object", [1.25, None, None]) and got[0][2][1] == '{"value":"x"}'
    assert [got[k][0] for k in range(8)] == ["object", "broken", None, "array", "scalar", "object", "object", "broken"]
    assert got[6][1] == [3.0] and all(got[k][1] == [] for k in (1, 2, 3, 4, 5, 7))

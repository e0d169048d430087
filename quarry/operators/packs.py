"""Gate packs: rules on their form, reachability of gates, and routing by symptom.

A pack is a row: id, start, symptoms, terminals (map) and gates (array of structs with next as map).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.gates import OPS, OUTCOMES, STATES, TERMINAL
from quarry.functions.text import any_of

from .shared import written

#: Rounds of a closure whose places are one table each.
MERGED = 16

GATE = "struct<id:string,type:string,title:string,quantity:string,condition:string,unit:string,op:string,spec_ref:string,literal:struct<value:double,min:double,max:double,unit:string,cite:string>,instruction:string,safeguard:string,risk:string,cuts_power:boolean,captures_dtcs:boolean,next:map<string,string>>"
PACK_SCHEMA = f"id string, title string, ecu_family string, symptoms array<string>, start string, terminals map<string,string>, gates array<{GATE}>"
IDENTIFIER, CODE, CITE = r"^[A-Za-z0-9_]+$", r"^[A-Z0-9_]+$", r"^\S.* p\.\d+$"
PROSE = ("title", "instruction", "safeguard", "risk")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Packs out of JSON files, one a file, with the file's name; its order is the order of routing."""
    return spark.read.schema(PACK_SCHEMA).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file")).orderBy("file")


def gates_of(packs: DataFrame) -> DataFrame:
    return packs.select(F.col("id").alias("pack"), "start", "terminals", F.transform("gates", lambda g: g["id"]).alias("ids"), F.posexplode("gates").alias("ord", "g")).select("pack", "start", "terminals", "ids", "ord", "g.*")


def edges_of(packs: DataFrame) -> DataFrame:
    """pack, gate, outcome, target."""
    return gates_of(packs).select("pack", F.col("id").alias("gate"), F.explode("next").alias("outcome", "target"))


def closure(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """pack, gate: everything that seen leads to over edges (pack, gate, target), itself included.

    A frontier of new places grows until it is empty. Edges and every round's places are written, so neither is
    computed twice and the plan of a round holds scans only; after MERGED rounds their tables become one.
    """
    edges = written(edges.select("pack", "gate", "target"), "edges")
    found = [written(seen.select("pack", "gate").distinct(), "places")]
    while True:
        known = reduce(DataFrame.union, found)
        front = found[-1].join(edges, ["pack", "gate"]).select("pack", F.col("target").alias("gate")).distinct()
        front = written(front.join(known, ["pack", "gate"], "left_anti"), "places")
        if front.isEmpty():
            return known
        found.append(front)
        if len(found) > MERGED:
            found = [written(known, "places"), front]


def _targets(gate: Column) -> Column:
    return F.map_values(F.coalesce(gate["next"], F.create_map().cast("map<string,string>")))


def reachable(packs: DataFrame) -> DataFrame:
    """Gates that can be reached from the start. A pack is one row, so its few gates are walked inside the row, as often as it has gates."""
    step = lambda seen: F.array_distinct(F.concat(seen, F.flatten(F.transform(F.filter("gates", lambda g: F.array_contains(seen, g["id"])), _targets))))
    seen = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("gates"), F.lit(1))), F.array("start"), lambda acc, _: step(acc))
    return packs.select(F.col("id").alias("pack"), F.explode(F.array_intersect(F.transform("gates", lambda g: g["id"]), seen)).alias("gate"))


def cyclic(packs: DataFrame) -> DataFrame:
    """Gates on a cycle or leading into one: those left after gates without a target among the rest go, again and again.

    A cycle of gates that all hold readings would never end; such packs are refused.
    """
    left = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size("gates"), F.lit(1))),
        F.transform("gates", lambda g: g["id"]),
        lambda rest, _: F.transform(F.filter("gates", lambda g: F.array_contains(rest, g["id"]) & F.arrays_overlap(_targets(g), rest)), lambda g: g["id"]),
    )
    return packs.select(F.col("id").alias("pack"), F.explode(left).alias("gate"))


def problems(packs: DataFrame) -> DataFrame:
    """pack, gate (null for the whole pack), problem. One pass over packs, one over their gates, one over their targets."""
    gates = gates_of(packs)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    when = lambda rule, text: F.when(F.coalesce(rule, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
    numeric, known, literal = F.col("type").isin("threshold", "window"), F.col("type").isin(*OUTCOMES), F.col("literal").isNotNull()
    expected = F.create_map(*(x for k, v in OUTCOMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    ids = F.transform("gates", lambda g: g["id"])
    terminals = F.coalesce("terminals", F.create_map().cast("map<string,string>"))

    of_packs = [
        when(F.col("id").isNull() | ~F.col("id").rlike(IDENTIFIER), "pack id missing or invalid"),
        when(F.coalesce(F.size("gates"), F.lit(0)) <= 0, "pack has no gates"),
        when((F.size("gates") > 0) & (F.size(F.array_distinct(ids)) < F.size("gates")), "duplicate gate ids"),
        when((F.size("gates") > 0) & ~F.coalesce(F.array_contains(ids, F.col("start")), F.lit(False)), "start gate does not exist"),
        when(F.exists("symptoms", lambda s: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), s).isNull()), "bad symptom pattern"),
        when(F.exists(F.map_keys(terminals), lambda c: ~c.rlike(CODE)), "terminal code must be A-Z, 0-9, underscore"),
        when(F.exists(F.map_values(terminals), lambda t: t.rlike(r"\d")), "digits in terminal text"),
    ]
    of_gates = [
        when(F.col("id").isNull() | ~F.col("id").rlike(IDENTIFIER), "invalid gate id"),
        when(F.col("type").isNull() | ~known, "unknown type"),
        when(numeric & (F.col("condition").isNull() | ~F.col("condition").isin(*STATES)), "bad condition"),
        when((F.col("type") == "boolean") & F.col("condition").isNotNull() & ~F.col("condition").isin(*STATES), "bad condition"),
        when(numeric & blank("unit"), "numeric gate needs a unit"),
        when(numeric & blank("spec_ref") & ~literal, "numeric gate needs spec_ref or a cited literal"),
        when((F.col("type") == "threshold") & (F.col("op").isNull() | ~F.col("op").isin(*OPS)), "threshold needs an op"),
        when(literal & known & (F.col("literal.cite").isNull() | ~F.col("literal.cite").rlike(CITE)), "literal needs a cite"),
        when(literal & (F.col("type") == "window") & (F.col("literal.min").isNull() | F.col("literal.max").isNull()), "window literal needs min and max"),
        when(literal & (F.col("type") == "threshold") & F.col("literal.value").isNull(), "threshold literal needs value"),
        *(when(known & F.col(c).rlike(r"\d"), f"digits in {c}") for c in PROSE),
        when(known & blank("instruction"), "missing instruction"),
        when(known & blank("safeguard"), "missing safeguard"),
        when(known & ~F.coalesce(F.array_sort(F.map_keys("next")) == F.array_sort(F.try_element_at(expected, F.col("type"))), F.lit(False)), "next must map exactly the outcomes"),
    ]
    code = F.regexp_extract("target", TERMINAL, 1)
    targets = gates.filter(known).select("pack", F.col("id").alias("gate"), "ids", "terminals", F.explode("next").alias("outcome", "target")).filter(~F.array_contains("ids", F.col("target")))
    wrong = F.when(code == "", " -> neither gate nor terminal").when(F.try_element_at("terminals", code).isNull(), " -> undefined terminal")
    formal = packs.select(F.col("id").alias("pack"), F.lit(None).cast("string").alias("gate"), F.explode(F.array_compact(F.array(*of_packs))).alias("problem"))
    formal = formal.unionByName(gates.select("pack", F.col("id").alias("gate"), F.explode(F.array_compact(F.array(*of_gates))).alias("problem")))
    formal = formal.unionByName(targets.select("pack", "gate", F.concat("outcome", wrong).alias("problem")).filter("problem is not null"))
    sound = packs.join(formal.select(F.col("pack").alias("id")).distinct(), "id", "left_anti")
    lost = gates_of(sound).select("pack", F.col("id").alias("gate")).join(reachable(sound), ["pack", "gate"], "left_anti").withColumn("problem", F.lit("unreachable from start"))
    loops = cyclic(sound).withColumn("problem", F.lit("on or before a cycle"))
    return formal.unionByName(lost).unionByName(loops)


def route(messages: DataFrame, patterns: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The first pack, in order, of which a symptom occurs in the text; null if none. Patterns are few, so they are part of the plan, not a join."""
    pack = F.lit(None).cast("string")
    for name, symptoms in reversed(patterns.items()):
        pack = F.when(any_of([F.col(text).rlike(f"(?i){p}") for p in symptoms]), name).otherwise(pack)
    return messages.withColumn("pack", pack)

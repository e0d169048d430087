"""What a gate makes of a reading: limits, outcomes and checks as column expressions.

A gate is a struct or set of columns: type (threshold, window, boolean), op, unit, condition. A spec has
value, vmin, vmax. A reading is num (double) or flag (boolean), with unit and state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import citation, col, general_number

#: Fixed values of packs and ledgers.
STATES = {"KEY_OFF": "key off", "KOEO": "key on, engine off", "CRANKING": "cranking", "RUNNING": "running", "UNPLUGGED": "unplugged"}
OUTCOMES = {"threshold": ("PASS", "FAIL"), "window": ("LOW", "PASS", "HIGH"), "boolean": ("YES", "NO")}
OPS = (">=", ">", "<=", "<")
TOKEN_PREFIX = "DEV-BRANCH-"
TOKEN = r"^COMMIT: DEV-BRANCH-(?:(INTAKE)|GATE-([A-Za-z0-9_]+)-(PASS|FAIL|LOW|HIGH|YES|NO)|(HALT-NO-TELEMETRY)|(RISK-ACK|PENDING)-([A-Za-z0-9_]+)|TERMINAL-([A-Z0-9_]+))$"
TERMINAL = r"^TERMINAL-([A-Z0-9_]+)$"


#: What a spec's limits make of a number: the outcomes in ascending order, and the limits between them. A limit that is included belongs to the outcome above it.
BANDS = {
    "window": (("LOW", "PASS", "HIGH"), (("min", True), ("max", False))),
    ">=": (("FAIL", "PASS"), (("low", True),)),
    ">": (("FAIL", "PASS"), (("low", False),)),
    "<=": (("PASS", "FAIL"), (("high", False),)),
    "<": (("PASS", "FAIL"), (("high", True),)),
}


def band(kind: str, op: str | None, spec: dict, number: float) -> str | None:
    """One number's outcome under one spec (value, min, max); None where the spec lacks a limit. The rule of evaluate for keyed state."""
    outcomes, limits = BANDS["window" if kind == "window" else op]
    one = spec.get("value")
    known = {"min": spec.get("min"), "max": spec.get("max")}
    known |= {"low": known["min"] if one is None else one, "high": known["max"] if one is None else one}
    if any(known[name] is None for name, _ in limits):
        return None
    return outcomes[sum(number >= known[name] if included else number > known[name] for name, included in limits)]


def limit(op: Column | str, value: Column | str, vmin: Column | str, vmax: Column | str) -> Column:
    return F.coalesce(col(value), F.when(col(op).isin(">=", ">"), col(vmin)).otherwise(col(vmax)))


def spec_fits(kind: Column | str, op: Column | str, value: Column | str, vmin: Column | str, vmax: Column | str) -> Column:
    return F.when(col(kind) == "window", col(vmin).isNotNull() & col(vmax).isNotNull()).when(col(kind) == "threshold", limit(op, value, vmin, vmax).isNotNull()).otherwise(True)


def evaluate(kind: Column | str, op: Column | str, num: Column | str, flag: Column | str, value: Column | str, vmin: Column | str, vmax: Column | str) -> Column:
    """The outcome; null where the spec does not fit or the reading is of the other kind."""
    kind, op, num, flag = col(kind), col(op), col(num), col(flag)
    known = {"min": col(vmin), "max": col(vmax), "low": F.coalesce(col(value), col(vmin)), "high": F.coalesce(col(value), col(vmax))}
    found = F.when(kind == "boolean", F.when(flag, "YES").when(~flag, "NO"))
    for rule, (outcomes, limits) in BANDS.items():
        above = [(num >= known[name] if included else num > known[name]).cast("int") for name, included in limits]
        place = above[0] if len(above) == 1 else above[0] + above[1]  # null if a limit or the number is
        applies = kind == "window" if rule == "window" else (kind == "threshold") & (op == rule)
        found = found.when(applies, F.get(F.array(*map(F.lit, outcomes)), place))
    return found


def captured_spec(kind: Column | str, values: Column | str) -> Column:
    """value, vmin, vmax out of an operator's numbers as given: the first for a threshold, the first two in either order for a window; null where they are too few."""
    kind, values = col(kind), col(values)
    none = F.lit(None).cast("double")
    one, pair = (kind == "threshold") & (F.size(values) >= 1), (kind == "window") & (F.size(values) >= 2)
    values = F.when(pair, F.array_sort(F.slice(values, 1, 2))).otherwise(values)
    first, last = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return F.when(one, F.struct(first.alias("value"), none.alias("vmin"), none.alias("vmax"))).when(pair, F.struct(none.alias("value"), first.alias("vmin"), last.alias("vmax")))


def reading_problem(kind: Column | str, gate_unit: Column | str, condition: Column | str, num: Column | str, flag: Column | str, unit: Column | str, state: Column | str) -> Column:
    """Why a reading cannot belong to a gate; null if it can."""
    kind, unit, state, labels = col(kind), F.coalesce(col(unit), F.lit("")), F.coalesce(col(state), F.lit("")), F.create_map(*(F.lit(x) for p in STATES.items() for x in p))
    named = lambda s: F.coalesce(F.try_element_at(labels, s), s)
    return (
        F.when((kind == "boolean") & col(flag).isNull(), "That step is a yes/no check.")
        .when((kind != "boolean") & col(num).isNull(), F.concat(F.lit("That step needs a "), col(gate_unit), F.lit(" reading, not yes/no.")))
        .when((kind != "boolean") & (unit != "") & (F.lower(unit) != F.lower(col(gate_unit))), F.concat(F.lit("That step needs "), col(gate_unit), F.lit(", you gave "), unit, F.lit(".")))
        .when((kind != "boolean") & (state != "") & (state != col(condition)), F.concat(F.lit("That step is measured "), named(col(condition)), F.lit(", not "), named(state), F.lit(".")))
    )


def spec_body(value: Column | str, vmin: Column | str, vmax: Column | str, unit: Column | str) -> Column:
    low, high, one = general_number(vmin), general_number(vmax), general_number(value)
    body = F.when(col(vmin).isNotNull() & col(vmax).isNotNull(), F.concat(low, F.lit("–"), high)).when(col(value).isNotNull(), one).when(col(vmin).isNotNull(), F.concat(F.lit("≥ "), low)).otherwise(F.concat(F.lit("≤ "), high))
    return F.btrim(F.concat(body, F.lit(" "), col(unit)))


def spec_text(kind: Column | str, op: Column | str, value: Column | str, vmin: Column | str, vmax: Column | str, unit: Column | str, cite: Column | str) -> Column:
    """Thresholds show their operator, other specs their value or range."""
    bound = F.concat(col(op), F.lit(" "), general_number(limit(op, value, vmin, vmax)), F.lit(" "), col(unit))
    body = F.when((col(kind) == "threshold") & limit(op, value, vmin, vmax).isNotNull(), bound).otherwise(spec_body(value, vmin, vmax, unit))
    return F.concat(body, F.lit(" ["), col(cite), F.lit("]"))


def token(kind: Column | str, gate: Column | str, outcome: Column | str) -> Column:
    kind, gate = col(kind), col(gate)
    body = F.when(kind == "INTAKE", F.lit("INTAKE")).when(kind == "HALT", F.lit("HALT-NO-TELEMETRY")).when(kind == "GATE", F.concat(F.lit("GATE-"), gate, F.lit("-"), col(outcome))).when(kind.isin("RISK-ACK", "PENDING", "TERMINAL"), F.concat(kind, F.lit("-"), gate))
    return F.concat(F.lit(TOKEN_PREFIX), body)


def parse_token(line: Column | str) -> Column:
    """The kind, gate (or terminal code) and outcome behind a commit line; null for other lines."""
    line = F.btrim(col(line))
    part = lambda i: F.nullif(F.regexp_extract(line, TOKEN, i), F.lit(""))
    kind = F.coalesce(part(1), F.when(part(2).isNotNull(), "GATE"), F.when(part(4).isNotNull(), "HALT"), part(5), F.lit("TERMINAL"))
    return F.when(line.rlike(TOKEN), F.struct(kind.alias("kind"), F.coalesce(part(2), part(6), part(7), F.lit("")).alias("gate"), F.coalesce(part(3), F.lit("")).alias("outcome")))


__all__ = ["BANDS", "band", "captured_spec", "citation", "evaluate", "limit", "parse_token", "reading_problem", "spec_body", "spec_fits", "spec_text", "token"]

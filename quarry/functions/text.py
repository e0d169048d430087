"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(strip(x), F.lit(""))


def slug(x: Column | str, mark: str = "_") -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", mark), F.lit(mark))


def spec_key(family: Column | str, quantity: Column | str, state: Column | str) -> Column:
    """family.quantity_state; what is empty is left out with its mark."""
    family, state = F.coalesce(col(family), F.lit("")), F.coalesce(col(state), F.lit(""))
    tail = F.concat(slug(quantity), F.when(state != "", F.concat(F.lit("_"), slug(state))).otherwise(""))
    return F.when(family != "", F.concat(slug(family), F.lit("."), tail)).otherwise(tail)


def first_number(x: Column | str) -> Column:
    """The first unsigned number in a text."""
    return F.try_element_at(F.regexp_extract_all(col(x), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), F.lit(1)).cast("double")


def number(x: Column | str) -> Column:
    """A whole text as number; null where it is none."""
    text = strip(x)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))


def year_range(x: Column | str) -> tuple[Column, Column]:
    """First and last year of `YYYY-YYYY` (hyphen or en dash) or `YYYY`."""
    text = strip(x)
    parts = F.regexp_extract(text, r"^(\d{4})\s*[-–]\s*\d{4}$", 1), F.regexp_extract(text, r"^\d{4}\s*[-–]\s*(\d{4})$", 1)
    single = F.when(text.rlike(r"^\d{4}$"), text.cast("int"))
    return tuple(F.coalesce(F.when(p != "", p.cast("int")), single) for p in parts)


def general_number(x: Column | str) -> Column:
    """At most six significant digits (ties of the shortest decimal form go to even) without trailing zeros, with an exponent for very large or small values.

    The digits are one whole number, cut as text: a formatter and patterns for each number would take most of a query's time.
    """
    x = col(x).cast("double")
    power = F.floor(F.log10(F.abs(x))).cast("double")  # null for 0
    ten = lambda n: F.pow(F.lit(10.0), n)
    scaled = F.abs(x) / ten(F.greatest(power - 5, F.lit(0.0))) * ten(F.least(F.greatest(5 - power, F.lit(0.0)), F.lit(300.0))) * ten(F.greatest(-295 - power, F.lit(0.0)))  # powers up to 22 are exact, above 308 there are none
    digits = F.rint(scaled).try_cast("long")  # null for what is not finite
    top = (power + F.when(digits >= 1_000_000, 1).when(digits < 1_000_000, 0)).cast("int")  # null where there are no digits
    text = digits.cast("string")  # six digits, or 1 and zeros
    pointed = lambda x, n: F.rtrim(F.rtrim(F.concat(F.substring(x, F.lit(1), n), F.lit("."), F.substring(x, n + 1, F.lit(12))), F.lit("0")), F.lit("."))
    plain = pointed(F.concat(F.substring(F.lit("0000"), F.lit(1), -top), text), F.greatest(top, F.lit(0)) + 1)
    scientific = F.concat(pointed(text, F.lit(1)), F.when(top < 0, "e-").otherwise("e+"), F.when(F.abs(top) < 10, "0").otherwise(""), F.abs(top).cast("string"))
    sign = F.when(x < 0, "-").otherwise("")
    other = F.when(x == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), "-0").otherwise("0")).when(F.isnan(x), "nan").when(x.isNotNull(), F.concat(sign, F.lit("inf")))
    return F.when((top >= -4) & (top < 6), F.concat(sign, plain)).when(top.isNotNull(), F.concat(sign, scientific)).otherwise(other)


def citation(file: Column | str, page: Column | str) -> Column:
    return F.when(col(page).isNull(), col(file)).otherwise(F.concat(col(file), F.lit(" p."), col(page).cast("string")))


def joined(mark: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty."""
    return F.concat_ws(mark, *(F.nullif(p, F.lit("")) for p in parts))


def year_label(start: Column | str, end: Column | str, make: Column | str, model: Column | str, note: Column | str) -> Column:
    note = F.coalesce(col(note), F.lit(""))
    label = F.concat(col(start).cast("string"), F.lit("-"), col(end).cast("string"), F.lit(" "), col(make), F.lit(" "), col(model))
    return F.when(note != "", F.concat(label, F.lit(" ("), note, F.lit(")"))).otherwise(label)


def tags(x: Column | str) -> Column:
    """`id:note;id:note` as an array of structs."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), ";"), strip), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("id"), strip(F.regexp_replace(F.when(F.contains(p, F.lit(":")), p).otherwise(""), r"^[^:]*:", "")).alias("note")))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, batch: bool = True) -> Column:
    """US dollars at prices per million tokens; a batch costs half."""
    full = (tokens_in * price_in + tokens_out * price_out) / 1_000_000
    return full / 2 if batch else full


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

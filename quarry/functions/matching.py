"""Fuzzy matching of makes and models, as column expressions that Catalyst can push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Spellings of makes in decoded vehicle numbers and in the tables.
MAKE_ALIASES = {"mercedes-benz": "mercedes", "vw": "volkswagen", "chevy": "chevrolet"}
SUBJECT = r"^(\d{4})\s+(\S+)\s+(.+)$"


def norm_make(make: Column | str, aliases: dict[str, str] = MAKE_ALIASES) -> Column:
    make = F.lower(strip(make))
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, make), make)


def norm_model(model: Column | str) -> Column:
    """Lower case, with hyphens, underscores and white space as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(col(model)), r"(?U)[-_\s]+", " "))


def model_matches(asked: Column | str, row: Column | str, separators: bool = False) -> Column:
    """Whether a model asked for means a row's model.

    Either contains the other; or one of the row's models begins with the first three digits in a row of
    the one asked for; or the row names the whole series of their first digit. With separators,
    separators are alike and also divide a row's models, a leading digit is enough for the series, and
    an empty model asked for means every row; without, an empty side means none.
    """
    if separators:
        asked, row = norm_model(asked), norm_model(row)
    else:
        asked, row = F.lower(strip(asked)), F.lower(strip(row))
    badge = F.regexp_extract(asked, r"(\d{3})", 1)
    parts = F.transform(F.split(row, r"[,/\s]+" if separators else "[,/]"), strip)
    by_badge = (badge != "") & F.exists(parts, lambda p: F.startswith(p, badge))
    digit = F.coalesce(F.nullif(F.substring(badge, 1, 1), F.lit("")), F.nullif(F.regexp_extract(asked, r"^(\d)", 1), F.lit(""))) if separators else F.nullif(F.substring(badge, 1, 1), F.lit(""))
    by_series = F.coalesce(row == F.concat(digit, F.lit(" series" if separators else "-series")), F.lit(False))
    found = F.contains(row, asked) | F.contains(asked, row) | by_badge | by_series
    return found if separators else found & (asked != "") & (row != "")


def parse_subject(query: Column | str) -> Column:
    """`YEAR MAKE MODEL` as a struct; null where the text has another form."""
    query = strip(query)
    year, make, model = (F.regexp_extract(query, SUBJECT, i) for i in (1, 2, 3))
    return F.when(query.rlike(SUBJECT), F.struct(year.cast("int").alias("year"), make.alias("make"), model.alias("model")))

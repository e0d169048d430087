"""Text in the order and equality that readers expect, by Spark's collations.

folded() compares without case as Unicode folds it (ß is ss, and the final sigma is a sigma; in upper case first, since a
collation without case keeps ß and ss apart), plain() also without accents; ordered() sorts as a locale does. Each gives a collated column, so that equality, grouping, joins and order
follow, and no second column of keys is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

ROOT = "UNICODE"


def folded(x: Column | str, locale: str = ROOT) -> Column:
    return F.collate(F.upper(col(x)), f"{locale}_CI")


def plain(x: Column | str, locale: str = ROOT) -> Column:
    return F.collate(col(x), f"{locale}_CI_AI")


def ordered(x: Column | str, locale: str = ROOT) -> Column:
    return F.collate(col(x), locale)

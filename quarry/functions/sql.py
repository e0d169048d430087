"""The text functions for spark.sql: scalar functions that Catalyst inlines, and chunks as a table function.

register(spark), then slug(x), norm_make(x), norm_model(x), spec_key(family, quantity, state) and general_number(x) are SQL
functions of the session. Their bodies are the column expressions of this package, so both say the same, and no Python
runs in them. chunk_text(text [, size [, overlap]]) is a table function to be joined laterally: place and text of each
chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from quarry.operators.retrieval import OVERLAP, REACH, SIZE, windows

from .matching import norm_make, norm_model
from .text import general_number, slug, spec_key

#: Name -> arguments with their types, the result's type, and the expression.
FUNCTIONS = {
    "slug": ({"x": "STRING"}, "STRING", slug), "norm_make": ({"x": "STRING"}, "STRING", norm_make), "norm_model": ({"x": "STRING"}, "STRING", norm_model),
    "spec_key": ({"family": "STRING", "quantity": "STRING", "state": "STRING"}, "STRING", spec_key), "general_number": ({"x": "DOUBLE"}, "STRING", general_number),
}


def _body(spark: SparkSession, arguments: dict[str, str], expression: Column) -> str:
    """An expression over some columns, as SQL."""
    rows = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in arguments.items()))
    return rows.select(expression)._jdf.queryExecution().analyzed().expressions().head().child().sql()


class ChunkText:
    """Windows of a text; analyze() checks the numbers once, before any row."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("chunk_text cuts a string")
        most, back = (default if x is None else x.value for x, default in ((size, SIZE), (overlap, OVERLAP)))
        if not isinstance(most, int) or not isinstance(back, int) or not 0 <= back < most:
            raise ValueError("size and overlap are constants, and an overlap is less than the size")
        return AnalyzeResult(StructType().add("place", IntegerType()).add("text", StringType()))

    def eval(self, text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(windows([text or ""], size, overlap, min(REACH, size - overlap - 1))[0])


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for name, (arguments, kind, function) in FUNCTIONS.items():
        body = _body(spark, arguments, function(*arguments).alias("found"))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {t}' for a, t in arguments.items())}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunk_text", udtf(ChunkText))

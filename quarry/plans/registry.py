"""Named queries over the driver's tables, and the same results in plain SQL."""

from __future__ import annotations

from . import gates, outputs, relational, streams, surface, texts

QUERIES = {**relational.QUERIES, **texts.QUERIES, **gates.QUERIES, **outputs.QUERIES, **streams.QUERIES, **surface.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **texts.ORACLE_SQL, **gates.ORACLE_SQL, **outputs.ORACLE_SQL, **streams.ORACLE_SQL, **surface.ORACLE_SQL}

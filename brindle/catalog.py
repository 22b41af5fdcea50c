"""All queries of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import decoder_queries, sql_queries

QUERIES = {**sql_queries.QUERIES, **decoder_queries.QUERIES}
ORACLES = {**sql_queries.ORACLES, **decoder_queries.ORACLES}

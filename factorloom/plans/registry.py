"""Queries and SQL over the market tables, by name."""

from __future__ import annotations

from . import feeds, inputs, market, outputs, reports, research

FLAGSHIP = "rank_by_country"
QUERIES: dict = {**market.QUERIES, **research.QUERIES, **reports.QUERIES, **feeds.QUERIES, **inputs.QUERIES, **outputs.QUERIES}
SQL: dict = {**market.SQL, **research.SQL, **reports.SQL, **feeds.SQL, **inputs.SQL, **outputs.SQL}

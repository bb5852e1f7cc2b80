"""Queries on the driver's tables, one or more per operator, with SQL where it can express them."""

from __future__ import annotations

from graphmill.catalog import entities, exchange, graph, maintenance, quality, relational, retrieval, search, summaries, temporal, text

QUERIES: dict = {}
SQL: dict = {}
for _part in (text, search, relational, entities, graph, temporal, maintenance, retrieval, quality, exchange, summaries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL

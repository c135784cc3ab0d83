"""All queries by name."""

from __future__ import annotations

from mnemospark.plans import corpus, events, recall, search

QUERIES = events.QUERIES | corpus.QUERIES | recall.QUERIES | search.QUERIES
ORACLE_SQL = events.ORACLE_SQL | corpus.ORACLE_SQL | recall.ORACLE_SQL | search.ORACLE_SQL

"""Registered queries of the activity and recall operators, each with the SQL that says the same in DuckDB."""

from mnemospark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The queries of this library outside waymark.llm, and their SQL."""

from __future__ import annotations

from waymark.plans import queries as plans

FLAGSHIP = "join_near_duplicates"


def queries():
    """name -> (spark, sf_dir) -> DataFrame."""
    return plans.queries()


def oracle_sql():
    """name -> DuckDB SQL over the same tables."""
    return plans.oracle_sql()

"""Registered queries: one per operator, each with the DuckDB statement it must equal.

A query takes a ``League`` over a data folder and works on its whole tables. The
key's prefix is the operator's number in the inventory. Means and sums of
doubles depend on the order of addition, so those columns (only) are rounded to
six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from courtlake.plans.league import League
from courtlake.plans.oracle_base import compose

QUERIES: dict[str, Callable[[League], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            STATEMENTS[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def joined_text(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as comma-joined text, so results compare as plain values."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def load_all() -> None:
    from courtlake.plans import (  # noqa: F401
        queries_box, queries_league, queries_models, queries_sequences, queries_sources,
    )


def queries() -> dict[str, Callable]:
    load_all()
    return {n: (lambda spark, sf_dir, fn=fn: fn(League(spark, sf_dir))) for n, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return {n: compose(sql) for n, sql in STATEMENTS.items()}

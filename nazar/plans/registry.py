"""Query registry: name → (Spark builder, oracle SQL or None).

A query takes ``(spark, sf_dir)`` and returns a lazy DataFrame; the oracle is
DuckDB SQL over the same parquet tables (registered as views by the caller).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from nazar.plans.fixtures import with_tables


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op_id: str


REGISTRY: dict[str, Query] = {}


def query(name: str, op_id: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Decorator registering a Spark query and its DuckDB oracle."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = with_tables(sql, *tables) if (sql and tables) else sql
        REGISTRY[name] = Query(name, fn, full, op_id)
        return fn
    return deco

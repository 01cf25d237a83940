"""Numeric helpers shared by operators and the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, d: int = 6) -> Column:
    """Round half up with IEEE arithmetic only: floor(x·10^d + ½)/10^d.

    Both engines evaluate it bit-identically, unlike ``round`` (Spark rounds
    the decimal string, DuckDB the scaled binary value).
    """
    s = float(10 ** d)
    return (F.floor(c * s + 0.5) / s).cast("double")


def rnd_sql(e: str, d: int = 6) -> str:
    return f"CAST(floor(({e}) * {float(10 ** d)!r} + 0.5) / {float(10 ** d)!r} AS DOUBLE)"

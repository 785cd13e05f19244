"""Registry of named queries: a Spark callable and, when SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation: doubles rounded so both engines hash the same digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rsql(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"

"""Registry of runnable queries over the given tables, with their SQL twins.

A query declares its output columns once (`name:l` bigint, `:d` double rounded to six
places, `:s` string, `:b` boolean); both the DataFrame and the SQL text are cast to that
declaration, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        col = F.col(name).cast(SPARK_TYPES[kind])
        out.append((F.round(col, 6) + F.lit(0.0) if kind == "d" else col).alias(name))
    return df.select(*out)


def shape_sql(sql: str, spec: str) -> str:
    """`sql` is `[WITH ...] SELECT ...`; the cast goes around it."""
    out = []
    for name, kind in _columns(spec):
        cast = f"CAST({name} AS {SQL_TYPES[kind]})"
        out.append((f"ROUND({cast}, 6) + 0.0" if kind == "d" else cast) + f" AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS q"


def query(name: str, spec: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(
            lambda spark, sf_dir: shape(fn(spark, sf_dir), spec), shape_sql(sql, spec) if sql else None
        )
        return fn

    return wrap

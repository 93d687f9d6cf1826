"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import Tables, tables

NUDGE = 1e-9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDS: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        BUILDS[name] = build
        QUERIES[name] = lambda spark, folder: plain_types(build(tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def plain_types(df: DataFrame) -> DataFrame:
    """Result columns in comparable form: 64-bit integers, doubles to six places.

    The nudge moves exact decimal ties off the rounding boundary, where the two engines differ.
    """
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double") + NUDGE, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"


def real(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)

"""Registration of queries with their SQL twins.

A column list such as ``series_id:s step:i anglez:f`` fixes names and types on both
sides: text, 64-bit integer, double cut to six places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.fixtures import CTES, Fixtures, fixtures, runs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The cut sits between round decimals, so values that are exact in decimal never fall
# on an edge where two engines could differ by one unit.
EDGE = 0.4142


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def cut(c: Column) -> Column:
    return F.floor(c * 1e6 + EDGE) / 1e6


def project(df: DataFrame, columns: str) -> DataFrame:
    def cast(name: str, kind: str):
        c = F.col(name)
        if kind == "s":
            return c.cast("string").alias(name)
        if kind == "i":
            return c.cast("long").alias(name)
        return cut(c.cast("double")).alias(name)

    return df.select(*[cast(n, k) for n, k in _fields(columns)])


def project_sql(columns: str, body: str) -> str:
    def cast(name: str, kind: str) -> str:
        if kind == "s":
            return f"cast({name} as varchar) as {name}"
        if kind == "i":
            return f"cast({name} as bigint) as {name}"
        return f"floor(cast({name} as double) * 1e6::double + {EDGE}::double) / 1e6::double as {name}"

    return f"select {', '.join(cast(n, k) for n, k in _fields(columns))} from ({body}\n)"


def _expand(body: str) -> str:
    return re.sub(r"\{runs:(\w+):(\w+):([\d.]+)\}", lambda m: runs_sql(*m.groups()), body)


def with_ctes(sql: str) -> str:
    """Prefix the fixture tables that ``sql`` needs, in order of dependence."""
    sql = _expand(sql)
    ordered: list[str] = []

    def visit(text: str, active: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|rec)_\w+", text)):
            if name in active or name in ordered:
                continue
            visit(_expand(CTES[name]), (*active, name))
            ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    parts = [
        f"{n} as {'' if n.startswith('rec_') else 'materialized '}({_expand(CTES[n])})" for n in ordered
    ]
    recursive = "recursive " if any(n.startswith("rec_") for n in ordered) else ""
    return f"with {recursive}" + ",\n".join(parts) + "\n" + sql


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` and, if given, its SQL twin."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return project(fn(fixtures(spark, sf_dir)), columns)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(project_sql(columns, sql))
        return fn

    return register

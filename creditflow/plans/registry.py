"""Queries by name: a Spark plan and, where SQL can say the same, DuckDB SQL.

A column list serves both sides: ``~c`` is rounded to six places, ``#c`` is cast to a long, ``@c`` is an array joined
to text, ``c`` is taken as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.plans.oracle import sql
from creditflow.plans.run import Run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _spark_columns(columns: str) -> list:
    out = []
    for c in columns.split():
        name = c.lstrip("~#@")
        col = {"~": F.round(F.col(name).cast("double"), 6), "#": F.col(name).cast("long"), "@": F.array_join(name, ">")}.get(c[0], F.col(name))
        out.append(col.alias(name))
    return out


def _sql_columns(columns: str) -> str:
    form = {"~": "round(CAST({0} AS DOUBLE), 6)", "#": "CAST({0} AS BIGINT)", "@": "array_to_string({0}, '>')"}
    return ", ".join(f"{form[c[0]].format(c[1:])} AS {c[1:]}" if c[0] in form else c for c in columns.split())


def of_run(name: str, build: Callable[[Run], DataFrame], columns: str, source: str | None = None) -> None:
    """A query over the tables of a run; ``source`` is what follows FROM."""
    QUERIES[name] = lambda spark, sf_dir: build(Run.shared(spark, sf_dir)).select(*_spark_columns(columns))
    if source:
        SQL[name] = sql(f"SELECT {_sql_columns(columns)} FROM {source}")


def of_tables(name: str, build: Query, text: str | None = None) -> None:
    QUERIES[name] = build
    if text:
        SQL[name] = text

"""Registered queries: one per operator of the inventory, each with its
DuckDB oracle where the operator is expressible in SQL.

Every query reads the test tables through the fixture views (whole tables,
no sampling) and runs the library's own operator.  Doubles are rounded to 6
places on both sides so the comparison is not thrown by summation order.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.sources.fixtures import Fixtures, duckdb_with

AS_OF = "2024-01-01 12:00:00"          # end of the compressed event range
AS_OF_US = 1704110400000000
MID = "2024-01-01 06:00:00"            # a point inside the range
MID_US = 1704088800000000


@dataclass
class Query:
    name: str
    fn: Callable[[Fixtures], DataFrame]
    sql: str | None
    doc: str = ""


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        CATALOG[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places (the oracle side does the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return finish(CATALOG[name].fn(Fixtures(spark, sf_dir)))


def spark_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, _n=n: run(spark, sf_dir, _n)) for n in CATALOG}


def oracle_sqls() -> dict[str, str]:
    return {n: duckdb_with(q.sql) for n, q in CATALOG.items() if q.sql is not None}


# Importing the query modules fills CATALOG.
from reqlens.plans import (queries_core, queries_series, queries_routing, queries_model, queries_io,  # noqa: E402,F401
                           queries_panels, queries_streaming)

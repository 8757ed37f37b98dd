"""Registration of queries with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload.fixtures import Fixtures
from workload.oracle_fixtures import with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def printable(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, so both engines print them alike."""
    formats = {"timestamp": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}
    return df.select(*[
        F.date_format(f.name, formats[f.dataType.typeName()]).alias(f.name) if f.dataType.typeName() in formats else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``build(fixtures) -> DataFrame`` under a name, with a DuckDB statement if there is one."""

    def wrap(build):
        QUERIES[name] = lambda spark, sf_dir: printable(build(Fixtures(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, extra)
        return build

    return wrap

"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.output import spark_output, sql_output

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A Spark query, its output columns and, where SQL can say it, its twin."""

    name: str
    build: Build
    spec: str
    sql: str | None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return spark_output(self.build(spark, sf), self.spec)

    @property
    def oracle(self) -> str | None:
        return None if self.sql is None else sql_output(self.sql, self.spec)


REGISTERED: dict[str, Query] = {}


def query(name: str, build: Build, spec: str, sql: str | None = None) -> None:
    if name in REGISTERED:
        raise ValueError(f"query {name} is registered twice")
    REGISTERED[name] = Query(name, build, spec, sql)


def registered() -> dict[str, Query]:
    """All queries; importing the modules registers them."""
    from workload import bars, portfolio, reference, storage  # noqa: F401

    return REGISTERED

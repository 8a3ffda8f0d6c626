"""Registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from songloom.sources.readers import Tables

Plan = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with the SQL that checks it."""

    def keep(plan: Plan) -> Plan:
        if plan.__name__ in ENTRIES:
            raise ValueError(f"{plan.__name__} is registered twice")
        ENTRIES[plan.__name__] = Entry(plan.__name__, plan, sql)
        return plan

    return keep

"""How an operator becomes a query: which views it reads, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.plans.views import TABLES, ansi_with, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, build: Callable[..., DataFrame], sql: str | None = None, *, with_spark: bool = False) -> None:
    """Register `build` over the named views (blank-separated); `sql` selects from the same views, and may begin with further WITH entries."""
    names = tuple(views.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = [view(spark, sf_dir, n) for n in names]
        return build(spark, *frames) if with_spark else build(*frames)

    QUERIES[name] = run
    if sql is not None:
        head = ansi_with(tuple(n for n in names if n not in TABLES))
        sql = sql.strip()
        if sql.startswith("WITH "):
            sql = f"{head},\n{sql[5:]}" if head else sql
        else:
            sql = f"{head}\n{sql}"
        ORACLES[name] = sql

"""Registered queries and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query, and its SQL where SQL can express it."""

    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "window_1h",
    """SELECT date_trunc('hour', ts) AS ts, event_type, round(sum(value), 2) AS sm, round(avg(value), 4) AS av, count(*) AS cnt
       FROM events GROUP BY 1, 2 ORDER BY sm DESC, ts, event_type LIMIT 20""",
)
def window_1h(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("ts"), "event_type")
        .agg(F.round(F.sum("value"), 2).alias("sm"), F.round(F.avg("value"), 4).alias("av"), F.count("*").alias("cnt"))
        .orderBy(F.desc("sm"), "ts", "event_type")
        .limit(20)
    )

"""Grouping: first and last by key, expression aggregates, and groups of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.windows import bucket


def _struct(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def first_by(col: str, keys: list[str]) -> Column:
    """The value of the row that is first in the order of the keys."""
    return F.min_by(F.col(col), _struct(keys))


def last_by(col: str, keys: list[str]) -> Column:
    return F.max_by(F.col(col), _struct(keys))


#: Aggregates by name; stddev is of the population.
AGGREGATES = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count, "stddev": F.stddev_pop}


def aggregate(df: DataFrame, **named: tuple[str, Column | str]) -> DataFrame:
    """One row of aggregates: ``aggregate(df, total=("sum", F.col("a") + F.col("b")))``."""
    return df.agg(*[AGGREGATES[f](c).alias(name) for name, (f, c) in named.items()])


def group(
    df: DataFrame,
    by: list[str],
    aggs: dict[str, Column],
    bare: list[str] = (),
    order: list[str] = (),
    last: bool = False,
    having: Column | None = None,
) -> DataFrame:
    """Groups sorted by their keys.

    bare: columns outside the aggregates; they take the value of the group's
    first row in the order of ``order``, or of its last row.
    """
    pick = last_by if last else first_by
    columns = [pick(c, list(order)).alias(c) for c in bare] + [c.alias(name) for name, c in aggs.items()]
    grouped = df.groupBy(*by).agg(*columns)
    return (grouped if having is None else grouped.where(having)).orderBy(*by)


def window_group(df: DataFrame, period: str, ts: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Groups of calendar windows of a time column, and other keys."""
    return df.groupBy(bucket(ts, period).alias(ts), *by).agg(*[c.alias(name) for name, c in aggs.items()])


def page(df: DataFrame, order: list[Column | str], n: int, skip: int = 0) -> DataFrame:
    """Rows skip to skip + n of an order."""
    ordered = df.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)

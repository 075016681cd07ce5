"""Predicates on ranges: structs of ``begin`` and ``end`` of any orderable type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(begin, end) -> Column:
    begin = F.col(begin) if isinstance(begin, str) else begin
    end = F.col(end) if isinstance(end, str) else end
    return F.struct(begin.alias("begin"), end.alias("end"))


def within(r1: Column, r2: Column, strict: bool = True) -> Column:
    """r1 lies inside r2; not strict: ends may meet."""
    if strict:
        return (r2["begin"] < r1["begin"]) & (r1["end"] < r2["end"])
    return (r2["begin"] <= r1["begin"]) & (r1["end"] <= r2["end"])


def value_within(value: Column, r: Column, strict: bool = True) -> Column:
    if strict:
        return (r["begin"] < value) & (value < r["end"])
    return value.between(r["begin"], r["end"])


def intersect(r1: Column, r2: Column) -> Column:
    """The ranges overlap; ends that only meet don't."""
    return (r1["end"] > r2["begin"]) & (r2["end"] > r1["begin"])


def equal(r1: Column, r2: Column) -> Column:
    return (r1["begin"] == r2["begin"]) & (r1["end"] == r2["end"])

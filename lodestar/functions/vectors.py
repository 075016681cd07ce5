"""Similarity of vectors (arrays of numbers) as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def similarity(a, b, kind: str = "cosine") -> Column:
    """cosine, dot, euclidean or manhattan; null for vectors of different lengths."""
    a, b = _col(a), _col(b)
    if kind == "cosine":
        value = F.try_divide(dot(a, b), norm(a) * norm(b))
    elif kind == "dot":
        value = dot(a, b)
    elif kind in ("euclidean", "manhattan"):
        gap = lambda x, y: x.cast("double") - y.cast("double")
        if kind == "euclidean":
            value = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y))))
        else:
            value = _sum(F.zip_with(a, b, lambda x, y: F.abs(gap(x, y))))
    else:
        raise ValueError(f"unknown similarity {kind}")
    return F.when(F.size(a) == F.size(b), value)


def top_similar(df: DataFrame, vector: str, query: list[float] | Column, k: int, kind: str = "cosine", order: str | None = None) -> DataFrame:
    """The k rows nearest to one query vector (numbers, or a column that has it), with ``similarity``; ties by the column ``order``."""
    given = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("similarity", similarity(vector, given, kind))
    best = F.col("similarity").asc() if kind in ("euclidean", "manhattan") else F.col("similarity").desc()
    return scored.orderBy(best, *([order] if order else [])).limit(k)

"""Joins on nearness: ranges that overlap and points within a radius, by bins.

Each side goes to the bins that it touches, equal bins are joined, and the exact
condition is checked; a pair that meets in several bins is kept in its first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import partitions

#: A range goes to this many bins at most; a longer one goes to bins of a coarser level.
MAX_BINS = 8
_LEVELS = 60
#: Pairs of one cell that a task looks at, about; cells of more are split, and there are as many tasks as all cells' pairs need.
PAIRS = 16_000_000
#: Tasks of a join at most.
MAX_TASKS = 20_000


def _binned(df: DataFrame, begin: str, end: str, width: float) -> DataFrame:
    """Rows with the bins that they touch, of a level at which they touch MAX_BINS at most."""
    size = F.greatest(F.col(end) - F.col(begin), F.lit(0.0)) / width
    level = F.greatest(F.ceil(F.log2(F.greatest(size / (MAX_BINS - 1), F.lit(1.0)))), F.lit(0)).cast("int")
    own = F.pow(F.lit(2.0), F.col("__level")) * width
    leveled = df.withColumn("__level", F.least(level, F.lit(_LEVELS)))
    return leveled.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(begin) / own), F.floor(F.col(end) / own))))


def _meeting(a: DataFrame, b: DataFrame, keys: list[str], split: int) -> DataFrame:
    """The join on some keys, over all cores; each key's rows of the left side are dealt to ``split`` groups, and those of the right go to each."""
    n = partitions(a.sparkSession)
    a = a.withColumn("__group", F.pmod(F.xxhash64(*[c for c in a.columns if c not in keys]), F.lit(split)))
    b = b.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))
    by = [*keys, "__group"]
    return a.repartition(n, *by).join(b.repartition(n, *by), by).drop("__group")


def overlap_join(left: DataFrame, right: DataFrame, begin: str, end: str, right_begin: str, right_end: str, width: float, split: int = 1) -> DataFrame:
    """Pairs whose ranges [begin, end] and [right_begin, right_end] overlap (ends that only meet don't).

    Numbers; ``width`` is a bin's, best near the length of a usual range.  Bins double
    from level to level, and a range is in a few bins of its level however long it
    is.  Levels that the two sides have are few, and each pair of them is joined at
    the coarser.  Where few bins have most ranges, ``split`` deals each to more tasks,
    for as many copies of the right side.
    """
    a, b = _binned(left, begin, end, width), _binned(right, right_begin, right_end, width)
    levels = a.select("__level").distinct().crossJoin(b.select(F.col("__level").alias("__other")).distinct())  # some dozens of rows
    at = F.greatest("__level", "__other").alias("__at")
    up = lambda level: F.floor(F.col("__bin") / F.pow(F.lit(2.0), F.col("__at") - F.col(level))).alias("__bin")
    reach = lambda df, level: df.join(F.broadcast(levels.select(level, at).distinct()), level)
    a = reach(a, "__level").select(*left.columns, "__level", "__at", up("__level")).distinct()
    b = reach(b.withColumnRenamed("__level", "__other"), "__other").select(*right.columns, "__other", "__at", up("__other")).distinct()
    first = F.floor(F.greatest(F.col(begin), F.col(right_begin)) / (F.pow(F.lit(2.0), F.col("__at")) * width))
    met = (F.col(end) > F.col(right_begin)) & (F.col(right_end) > F.col(begin)) & (F.col("__bin") == first) & (F.col("__at") == F.greatest("__level", "__other"))
    return _meeting(a, b, ["__at", "__bin"], split).where(met).select(*left.columns, *right.columns)


def within_join(left: DataFrame, right: DataFrame, x: str, y: str, right_x: str, right_y: str, radius: float, split: int = 1) -> DataFrame:
    """Pairs of points within a radius, with ``distance``; a grid of cells as wide as the radius.

    The right side, best the smaller, goes to nine cells.  The points of each cell are
    counted first, as pairs grow with the square of the tables: each cell's left points
    are dealt to ``split`` groups, more where its pairs are more than PAIRS, the right
    ones go to each, and the tasks are as many as all pairs need.
    """
    cell = lambda c, d=0: F.floor(F.col(c) / radius) + d
    near = F.explode(F.array(*[F.struct(cell(right_x, i).alias("i"), cell(right_y, j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumns({"__i": cell(x), "__j": cell(y)})
    b = right.withColumn("__cell", near).select("*", F.col("__cell.i").alias("__i"), F.col("__cell.j").alias("__j")).drop("__cell")
    count = lambda df, c: df.groupBy("__i", "__j").agg(F.count("*").cast("double").alias(c))
    pairs = count(a, "__n").join(count(b, "__m"), ["__i", "__j"]).select("__i", "__j", (F.col("__n") * F.col("__m")).alias("__pairs"))
    total, most = pairs.agg(F.sum("__pairs"), F.max("__pairs")).first()
    n = int(min(max(partitions(left.sparkSession), (total or 0) // PAIRS), MAX_TASKS))
    groups = F.lit(split)
    if (most or 0) > PAIRS * split:
        full = pairs.where(F.col("__pairs") > PAIRS * split).select("__i", "__j", F.ceil(F.col("__pairs") / PAIRS).alias("__groups"))
        a, b = (df.join(full, ["__i", "__j"], "left") for df in (a, b))
        groups = F.coalesce("__groups", F.lit(split))
    a = a.withColumn("__group", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), groups)).drop("__groups")
    b = b.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1))).drop("__groups")
    by = ["__i", "__j", "__group"]
    dx, dy = F.col(x) - F.col(right_x), F.col(y) - F.col(right_y)
    square = dx * dx + dy * dy
    met = a.repartition(n, *by).join(b.repartition(n, *by), by).where(square <= radius * radius * (1 + 1e-9)).drop(*by)
    # a root is quick; where squares are too small or too large to be exact, it isn't the distance
    pairs = met.withColumn("distance", F.when(square.between(1e-280, 1e280), F.sqrt(square)).otherwise(F.hypot(dx, dy)))
    return pairs.where(F.col("distance") <= radius)

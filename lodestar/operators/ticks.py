"""Time-series tables: roll-ups by calendar windows over every subset of the keys, and retention.

A tick table has a row for each window and each combination of keys, where any
keys may be ``*`` for all.  Its measures are sums, so they are made in two steps:
one aggregation by window and all keys, and the cube over its much fewer rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.windows import bucket, parse_period, retention_seconds

ALL = "*"
#: Keys of a cube at most: a row has 2 ** keys groups.
MAX_KEYS = 10

_WORDS = {"second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w", "month": "M", "quarter": "q", "year": "y", "decade": "D"}


@dataclass
class TimeSeries:
    """Ticks with their retentions, and the base table's retention; None keeps all."""

    ticks: dict[str, str | None] = field(default_factory=dict)
    retention: str | None = None

    def add_tick(self, tick: str, retention: str | None = None) -> TimeSeries:
        parse_period(tick)
        return TimeSeries({**self.ticks, tick: retention}, self.retention)

    def set_retention(self, tick: str | None, retention: str | None) -> TimeSeries:
        """Another retention of a tick, or with None as the tick of the base table."""
        if tick is None:
            return TimeSeries(dict(self.ticks), retention)
        if tick not in self.ticks:
            raise ValueError(f"no tick {tick!r}")
        return TimeSeries({**self.ticks, tick: retention}, self.retention)

    def drop_tick(self, tick: str) -> TimeSeries:
        return TimeSeries({t: r for t, r in self.ticks.items() if t != tick}, self.retention)


def _period(text: str) -> str:
    m = re.fullmatch(r"(\d+)\s*_?([A-Za-z]+)", text.strip())
    if not m:
        raise ValueError(f"not a period: {text!r}")
    word = m[2].lower().rstrip("s")
    return m[1] + (_WORDS[word] if word in _WORDS else m[2])


def parse_timeseries(text: str) -> TimeSeries:
    """``5m:1d,1h:48h|5y``: ticks with their retentions, and after the bar the base table's."""
    text = text.strip()
    if text.lower().startswith("timeseries"):
        text = text[text.index("(") + 1 : text.rindex(")")]
    ticks, _, base = text.partition("|")
    out: dict[str, str | None] = {}
    for part in filter(None, map(str.strip, ticks.split(","))):
        tick, _, keep = part.partition(":")
        tick = _period(tick)
        parse_period(tick)
        out[tick] = _period(keep) if keep.strip() not in ("", "0") else None
    return TimeSeries(out, _period(base) if base.strip() not in ("", "0") else None)


def _partial(rollup: list[str], order: list[Column]) -> list[Column]:
    """Sums of one group from which those of larger groups follow."""
    out = [F.count("*").alias("counter")]
    latest = F.struct(*order)
    for c in rollup:
        x = F.col(c).cast("double")
        out += [F.sum(x).alias(f"{c}__sum"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.count(c).alias(f"{c}__n")]
        out += [F.sum(x * x).alias(f"{c}__squares"), F.max(F.struct(latest.alias("at"), F.col(c).alias("value"))).alias(f"{c}__last")]
    return out


def _merged(rollup: list[str]) -> list[Column]:
    out = [F.sum("counter").alias("counter")]
    for c in rollup:
        total, n = F.sum(f"{c}__sum"), F.sum(f"{c}__n")
        mean = F.try_divide(total, n)
        out += [
            F.max(f"{c}__last")["value"].alias(c),
            total.alias(f"{c}::sum"),
            F.min(f"{c}__min").alias(f"{c}::min"),
            F.max(f"{c}__max").alias(f"{c}::max"),
            mean.alias(f"{c}::avg"),
            F.greatest(F.try_divide(F.sum(f"{c}__squares"), n) - mean * mean, F.lit(0.0)).alias(f"{c}::var"),
        ]
    return out


def build_tick(df: DataFrame, tick: str, ts: str, keys: list[str], rollup: list[str], order: list[str] = ()) -> DataFrame:
    """The tick table of a batch.

    Columns: ts (the window's start), the keys as strings (``*`` for all), counter,
    and for each rollup column c its latest value c and c::sum, c::min, c::max,
    c::avg and c::var (of the population).  ``order`` breaks ties of the latest.
    """
    if len(keys) > MAX_KEYS:
        raise ValueError(f"a cube over more than {MAX_KEYS} keys")
    latest = [F.col("__ts"), *[F.col(c) for c in order]]
    timed = df.withColumn("__ts", F.col(ts)).withColumn(ts, bucket(ts, tick))
    partial = timed.groupBy(ts, *[F.col(k).cast("string").alias(k) for k in keys]).agg(*_partial(rollup, latest))
    if not keys:
        return partial.groupBy(ts).agg(*_merged(rollup))
    names = [f"__key{i}" for i in range(len(keys))]
    for k, name in zip(keys, names, strict=True):
        partial = partial.withColumnRenamed(k, name)
    # one row for each subset of the keys; the window is in all of them
    masks = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(keys) - 1))).alias("__mask")
    spread = partial.select("*", masks)
    cube = [F.when(F.col("__mask").bitwiseAND(1 << i) > 0, F.lit(ALL)).otherwise(F.col(n)).alias(k) for i, (k, n) in enumerate(zip(keys, names, strict=True))]
    return spread.groupBy(ts, *cube).agg(*_merged(rollup))


def build_ticks(df: DataFrame, series: TimeSeries, ts: str, keys: list[str], rollup: list[str], order: list[str] = ()) -> dict[str, DataFrame]:
    """The tick tables of a time-series table by tick."""
    return {tick: build_tick(df, tick, ts, keys, rollup, order) for tick in series.ticks}


def slice_tick(tick_table: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """The rows of one combination of the table's keys: those named at their values, the others summed over."""
    for k in keys:
        tick_table = tick_table.where(F.col(k) == str(values.get(k, ALL)))
    return tick_table


def retain(df: DataFrame, ts: str, period: str | None, now: Column | None = None) -> DataFrame:
    """The rows that the retention keeps, counted back from ``now``.

    A plain comparison with a time, so that it is pushed down to the scan.
    """
    if period is None:
        return df
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(retention_seconds(period)))))


def merge_ticks(old: DataFrame, new: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """A tick table with the windows of ``new`` in place of its own: for windows that late rows have changed."""
    return old.join(new.select(ts).distinct(), ts, "left_anti").unionByName(new)

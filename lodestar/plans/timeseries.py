"""Queries of time series: calendar windows, tick tables and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import aggregates, ticks
from lodestar.plans.registry import register, table

#: The start of each window in SQL.
_BUCKETS = {
    "30s": "date_trunc('minute', ts) + to_seconds((second(ts) // 30 * 30)::INTEGER)",
    "5m": "date_trunc('hour', ts) + to_minutes(minute(ts) // 5 * 5)",
    "6h": "date_trunc('day', ts) + to_hours(hour(ts) // 6 * 6)",
    "3d": "date_trunc('month', ts) + to_days(((day(ts) - 1) // 3 * 3)::INTEGER)",
    "1w": "date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY",
    "3M": "make_timestamp(year(ts), (month(ts) - 1) // 3 * 3 + 1, 1, 0, 0, 0)",
    "1q": "date_trunc('quarter', ts)",
    "1y": "date_trunc('year', ts)",
    "1D": "make_timestamp(1900 + (year(ts) - 1900) // 10 * 10, 1, 1, 0, 0, 0)",
}
_NAMES = {"30s": "window_30s", "5m": "window_5m", "6h": "window_6h", "3d": "window_3d", "1w": "window_1w", "3M": "window_3month", "1q": "window_1quarter", "1y": "window_1year", "1D": "window_1decade"}


def _windowed(period: str):
    def query(spark, sf):
        aggs = {"n": F.count("*"), "total": F.round(F.sum("value"), 2), "top": F.max("value")}
        return aggregates.window_group(table(spark, sf, "events"), period, "ts", ["event_type"], aggs)

    return query


for _period, _sql in _BUCKETS.items():
    register(_NAMES[_period], f"SELECT ({_sql})::TIMESTAMP AS ts, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY 1, 2")(_windowed(_period))

_TICK_SQL = """SELECT {bucket} AS ts, CASE WHEN grouping(event_type) = 1 THEN '*' ELSE event_type END AS event_type, CASE WHEN grouping(user_id) = 1 THEN '*' ELSE user_id::VARCHAR END AS user_id,
  count(*) AS counter, arg_max(value, (e.ts, event_id)) AS value, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(avg(value) + 1e-7, 4) AS mean, round(var_pop(value) + 1e-5, 3) AS var
  FROM events e GROUP BY {bucket}, CUBE (event_type, user_id)"""


def _tick(spark, sf, period):
    made = ticks.build_tick(table(spark, sf, "events"), period, "ts", ["event_type", "user_id"], ["value"], order=["event_id"])
    names = {"value::sum": "total", "value::min": "low", "value::max": "high", "value::avg": "mean", "value::var": "var"}
    made = made.withColumnsRenamed(names)
    return made.withColumns({"total": F.round("total", 2), "mean": F.round(F.col("mean") + 1e-7, 4), "var": F.round(F.col("var") + 1e-5, 3)})


@register("tick_cube_1h", _TICK_SQL.format(bucket="date_trunc('hour', e.ts)"))
def tick_cube_1h(spark, sf):
    return _tick(spark, sf, "1h")


@register("tick_cube_1d", _TICK_SQL.format(bucket="date_trunc('day', e.ts)"))
def tick_cube_1d(spark, sf):
    return _tick(spark, sf, "1d")


@register(
    "tick_slice",
    """SELECT date_trunc('day', ts) AS ts, event_type, count(*) AS counter, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""",
)
def tick_slice(spark, sf):
    return _tick(spark, sf, "1d").where("user_id = '*' AND event_type <> '*'").select("ts", "event_type", "counter", "total")


@register("retention", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def retention(spark, sf):
    events = table(spark, sf, "events")
    dated = events.crossJoin(events.agg(F.max("ts").alias("now")))  # of one row
    return ticks.retain(dated, "ts", "48h", F.col("now")).select("event_id", "ts")


@register("tick_merge_late", "SELECT date_trunc('day', ts) AS ts, event_type, count(*) AS counter FROM events GROUP BY 1, 2")
def tick_merge_late(spark, sf):
    """A tick table without the events of odd ids, and then with them: their windows are made anew."""
    events = table(spark, sf, "events")
    late = F.col("event_id") % 2 == 1
    old = ticks.build_tick(events.where(~late), "1d", "ts", ["event_type"], ["value"])
    touched = events.where(late).select(F.date_trunc("day", "ts").alias("day")).distinct()
    new = ticks.build_tick(events.join(touched, F.date_trunc("day", "ts") == F.col("day"), "left_semi"), "1d", "ts", ["event_type"], ["value"])
    return ticks.merge_ticks(old, new, "ts", ["event_type"]).where("event_type <> '*'").select("ts", "event_type", "counter")

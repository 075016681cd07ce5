"""Calendar windows: the start of the window of a time, by a period such as 15m, 2h, 3d, 1w, 3M, 1q, 1y or 1D.

Seconds, minutes and hours are counted within the next larger unit, days within
their month, weeks from Sunday, months and quarters within their year, years and
decades from 1900.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERIOD = re.compile(r"(\d+)\s*([smhdwMqyD])")

#: Days that a retention of one unit keeps.
RETENTION_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "M": 31 * 86400, "q": 93 * 86400, "y": 365 * 86400, "D": 3650 * 86400}


def parse_period(period: str) -> tuple[int, str]:
    """(count, unit); seconds and minutes must divide 60, hours 24."""
    m = _PERIOD.fullmatch(period.strip())
    if not m or int(m[1]) < 1:
        raise ValueError(f"not a period: {period!r}")
    n, unit = int(m[1]), m[2]
    whole = {"s": 60, "m": 60, "h": 24}.get(unit)
    if whole and whole % n:
        raise ValueError(f"{n} does not divide the {whole} of the next unit")
    return n, unit


def bucket(ts, period: str) -> Column:
    """The start of the window that holds ``ts``, a timestamp."""
    n, unit = parse_period(period)
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    if unit in "smh":
        size = n * {"s": 1, "m": 60, "h": 3600}[unit]
        top = F.date_trunc({"s": "minute", "m": "hour", "h": "day"}[unit], t)
        into = F.unix_seconds(t) - F.unix_seconds(top)
        return F.timestamp_seconds(F.unix_seconds(top) + into - into % size)
    if unit == "d":
        return F.date_trunc("month", t) + F.make_dt_interval((F.floor((F.dayofmonth(t) - 1) / n) * n).cast("int"))
    if unit == "w":
        day = F.make_dt_interval(F.lit(1))
        return F.date_trunc("week", t + day) - day
    if unit in "Mq":
        months = n * (3 if unit == "q" else 1)
        month = (F.floor((F.month(t) - 1) / months) * months + 1).cast("int")
        return F.make_date(F.year(t), month, F.lit(1)).cast("timestamp")
    years = n * (10 if unit == "D" else 1)
    year = (1900 + F.floor((F.year(t) - 1900) / years) * years).cast("int")
    return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")


def retention_seconds(period: str) -> int:
    n, unit = _PERIOD.fullmatch(period.strip()).groups()
    return int(n) * RETENTION_SECONDS[unit]

"""Scalar functions as Columns: numbers, strings, dates, units and predicates.

All of them are compositions of built-in expressions, so that they stay inside
whole-stage code generation.  A function that has no value for an input gives
null; ``drop_failed`` drops the rows where that happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees in a radian as this engine's queries use it, and metres in a mile.
DEGREES_IN_RADIAN = 57.295779513
METERS_IN_MILE = 1609.344


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def drop_failed(df: DataFrame, *cols: str) -> DataFrame:
    """The rows where all of the named results exist."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


# numbers


def acos(x) -> Column:
    """Arc cosine; 0 outside its domain."""
    return F.when(F.abs(_col(x)) > 1, F.lit(0.0)).otherwise(F.acos(_col(x)))


def asin(x) -> Column:
    """Arc sine; 0 outside its domain."""
    return F.when(F.abs(_col(x)) > 1, F.lit(0.0)).otherwise(F.asin(_col(x)))


def cot(x) -> Column:
    """Cotangent; null where the tangent is less than 1e-10 in size."""
    t = F.tan(_col(x))
    return F.when(F.abs(t) >= 1e-10, 1.0 / t)


def ceil(x) -> Column:
    """Ceiling as a double; integers keep their type if ``F.ceil`` is used directly."""
    return F.ceil(_col(x)).cast("double")


def floor(x) -> Column:
    return F.floor(_col(x)).cast("double")


def mod(a, b) -> Column:
    """Floating remainder with the sign of the dividend; null for a zero divisor."""
    b = _col(b).cast("double")
    return F.when(b != 0, _col(a).cast("double") % b)


def int_mod(a, b) -> Column:
    """Remainder of both sides cut to integers; null for a zero divisor."""
    b = _col(b).cast("long")
    return F.when(b != 0, _col(a).cast("long") % b)


def divide(a, b) -> Column:
    """Division of reals; null for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def int_divide(a, b) -> Column:
    """Division of integers, cut toward zero; null for a zero divisor."""
    a, b = _col(a).cast("long"), _col(b).cast("long")
    return F.when(b != 0, (a - a % b) / b).cast("long")


def power(a, b, integers: bool = False) -> Column:
    p = F.pow(_col(a), _col(b))
    return p.cast("long") if integers else p


def radians(x) -> Column:
    return _col(x) / F.lit(DEGREES_IN_RADIAN)


def degrees(x) -> Column:
    return _col(x) * F.lit(DEGREES_IN_RADIAN)


# strings


def substr(s, start: int, length: int, encoding: str | None = None) -> Column:
    """1-based; of bytes unless an encoding is named, then of characters."""
    if encoding:
        return F.substring(_col(s), start, length)
    return F.decode(F.substring(F.encode(_col(s), "UTF-8"), start, length), "UTF-8")


def length(x) -> Column:
    """Bytes of the value's text."""
    return F.octet_length(_col(x).cast("string"))


def strdiff(a, b) -> Column:
    """Levenshtein distance."""
    return F.levenshtein(_col(a), _col(b))


def concat(*parts) -> Column:
    return F.concat(*[_col(p).cast("string") for p in parts])


def like(s, pattern: str) -> Column:
    """``abc%`` begins with, ``%abc`` ends with, ``%abc%`` contains, without % is equal.

    An underscore is itself.  With a % inside, all parts must follow one another.
    """
    s = _col(s)
    parts = pattern.split("%")
    if len(parts) == 1:
        return s == pattern
    if len(parts) == 2 and not parts[1]:
        return s.startswith(parts[0])
    if len(parts) == 2 and not parts[0]:
        return s.endswith(parts[1])
    if len(parts) == 3 and not parts[0] and not parts[2]:
        return s.contains(parts[1])
    escaped = pattern.replace("\\", "\\\\").replace("_", "\\_")
    return s.like(escaped)


def match(s, pattern: str) -> Column:
    """The whole string matches the regular expression."""
    return _col(s).rlike(rf"\A(?:{pattern})\z")


# dates and times


def datediff(unit: str, begin, end) -> Column:
    """end - begin.  Seconds, minutes, hours and days are elapsed time cut toward zero; months and years go by the calendar's fields."""
    begin, end = _col(begin).cast("timestamp"), _col(end).cast("timestamp")
    seconds = F.unix_seconds(end) - F.unix_seconds(begin)
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}.get(unit)
    if size:
        return ((seconds - seconds % size) / size).cast("long")
    years = F.year(end) - F.year(begin)
    if unit == "year":
        return years.cast("long")
    if unit == "month":
        return (years * 12 + F.month(end) - F.month(begin)).cast("long")
    raise ValueError(f"unknown unit {unit}")


def date_text(t) -> Column:
    return F.date_format(_col(t), "yyyy-MM-dd")


def dayofweek(t) -> Column:
    """0 is Sunday, 6 is Saturday."""
    return F.dayofweek(_col(t)) - 1


def curdate() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def curtime() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


sysdate = now


def time() -> Column:
    """Seconds since the epoch."""
    return F.unix_timestamp()


_SECONDS = {"S": 1, "M": 60, "H": 3600, "D": 86400, "W": 604800}


def tosecond(span: str) -> int:
    """Seconds of "5M", "2H", "1D" or "3W"."""
    return int(span[:-1]) * _SECONDS[span[-1].upper()]


def tomicrosecond(span: str) -> int:
    return tosecond(span) * 1_000_000


# units


def metertomile(x) -> Column:
    return _col(x) / F.lit(METERS_IN_MILE)


def miletometer(x) -> Column:
    return _col(x) * F.lit(METERS_IN_MILE)


def kilometertomile(x) -> Column:
    return _col(x) / F.lit(METERS_IN_MILE / 1000)


def miletokilometer(x) -> Column:
    return _col(x) * F.lit(METERS_IN_MILE / 1000)

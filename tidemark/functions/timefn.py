"""Scalar column functions over time stamps (all JVM-side built-ins).

Time stamps may be ``timestamp`` or ``timestamp_ntz``; differences are taken
with ``timestampdiff`` so no session time zone enters the arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock time stamp."""
    return _epoch_micros(_c(c))


def _epoch_micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz"))


def epoch_seconds(c) -> Column:
    """Whole seconds since 1970-01-01 (floor)."""
    return F.floor(_epoch_micros(_c(c)) / F.lit(1_000_000)).cast("long")


def add_seconds(ts, seconds) -> Column:
    """``ts + seconds`` (seconds may be a column); keeps the time-stamp type."""
    return F.timestamp_add("SECOND", _c(seconds) if not isinstance(seconds, (int, float)) else F.lit(int(seconds)), _c(ts))


def add_micros(ts, micros) -> Column:
    return F.timestamp_add("MICROSECOND", _c(micros) if not isinstance(micros, (int, float)) else F.lit(int(micros)), _c(ts))


def whole_days_between(start, end) -> Column:
    """Whole days between two stamps, as ``(end - start).days`` (floor of the span)."""
    return F.floor((_epoch_micros(_c(end)) - _epoch_micros(_c(start))) / F.lit(86_400_000_000)).cast("long")


#: Forms tried after the general parse: month before day as in ``1/24/24 0:05``, day before month only where that fails.
_DAYS = ["M/d/yy", "M/d/yyyy", "yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy"]
_DAYS += ["MMMM d yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d/M/yyyy", "d/M/yy", "d.M.yyyy"]
_CLOCKS = ["H:mm", "H:mm:ss", "h:mm a", ""]
TIME_FORMS = [f"{day} {clock}".strip() for day in _DAYS for clock in _CLOCKS] + ["yyyy-MM-dd'T'HH:mm:ss"]


def parse_timestamp(c) -> Column:
    """General parse, else one of :data:`TIME_FORMS`; bad text becomes NULL."""
    s = F.trim(_c(c).cast("string"))
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in TIME_FORMS]).cast("timestamp_ntz")


def coerce_numeric(c) -> Column:
    """Text or number to double; unparseable text and NaN become NULL."""
    d = F.trim(_c(c).cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def format_timestamp(c) -> Column:
    """``yyyy-MM-dd HH:mm`` display text of a stamp or of stamp text."""
    col = _c(c)
    return F.date_format(F.coalesce(col.try_cast("timestamp_ntz"), parse_timestamp(col)), "yyyy-MM-dd HH:mm")


def format_export(c) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` export text."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def pct_change(cur, prev) -> Column:
    """Percentage change; 0 when the previous value is 0."""
    cur, prev = _c(cur), _c(prev)
    return F.when(prev == 0, F.lit(0.0)).otherwise((cur - prev) / prev * 100.0)


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(c))


# Two-sided normal quantiles for the band levels offered (80, 90, 95 %).
Z_FOR_LEVEL = {80: 1.2816, 90: 1.6449, 95: 1.9600}


def z_for_level(level: float) -> float:
    """Two-sided normal quantile for a band level in percent."""
    if int(level) in Z_FOR_LEVEL and float(level) == int(level):
        return Z_FOR_LEVEL[int(level)]
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + float(level) / 200.0)


TWO_PI = 2 * math.pi

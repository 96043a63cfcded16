"""Calendar expressions (all JVM-side built-ins).

Weekday convention is Monday = 0 (``weekday``), never ``dayofweek``
(Sunday = 1). ISO week via ``weekofyear``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_day(ts) -> Column:
    return F.to_date(col_of(ts))


def year_month(ts) -> Column:
    return F.date_format(col_of(ts), "yyyy-MM")


def weekday(ts) -> Column:
    return F.weekday(col_of(ts))


def is_weekend(ts) -> Column:
    return F.weekday(col_of(ts)) >= 5


def calendar_features(df: DataFrame, ts: str = "opened", prefix: str = "") -> DataFrame:
    """P-03: year, month, day, hour, day_of_week (Mon=0), ISO week, quarter, is_weekend."""
    c = F.col(ts)
    return df.withColumns({
        f"{prefix}year": F.year(c),
        f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c),
        f"{prefix}hour": F.hour(c),
        f"{prefix}day_of_week": F.weekday(c),
        f"{prefix}week_of_year": F.weekofyear(c),
        f"{prefix}quarter": F.quarter(c),
        f"{prefix}is_weekend": (F.weekday(c) >= 5).cast("int"),
    })


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python datetime/date, via its ISO text.

    ``F.lit(datetime)`` would go through the Python process's local zone;
    casting the wall-clock text is zone-independent."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    else:
        text = f"{value.isoformat()} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def month_first(ym) -> Column:
    """'yyyy-MM' -> first day of that month."""
    return F.to_date(F.concat(col_of(ym), F.lit("-01")))


def end_of_day(d: dt.date) -> Column:
    """Inclusive end bound used by the raw filter: d + 1 day - 1 second."""
    return ts_lit(dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1, seconds=-1))

"""Row filters over clean requests and rollups (P-04 .. P-13, P-16).

Bounds are driver-side parameters (not data), parsed once here; the
predicates themselves are plain column comparisons that Catalyst pushes into
the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RESOLUTION_MAX_HOURS
from ..functions.calendar import end_of_day, month_first, ts_lit


# Usual written forms of a day bound besides ISO 8601.
DAY_FORMS = ("%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%m-%d-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
             "%b %d %Y", "%B %d %Y")


def parse_day(s: str | dt.date | None) -> dt.date | None:
    """Driver-side parse of a day bound: None and "" are no bound; text that is
    no date raises, as dropping the bound would widen the answer unseen."""
    if s is None or s == "":
        return None
    if isinstance(s, dt.date):
        return s.date() if isinstance(s, dt.datetime) else s
    text = str(s).strip()
    try:
        return dt.datetime.fromisoformat(text).date()
    except ValueError:
        pass
    for form in DAY_FORMS:
        try:
            return dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
    raise ValueError(f"not a date: {s!r}")


PARTITION_DATE = "opened_date"    # day partition column of the written clean table


def filter_date_range(df: DataFrame, start: str | None, end: str | None, col: str = "opened") -> DataFrame:
    """P-04: ``opened >= start`` and ``opened <= end + 1 day - 1 second``.

    On the day-partitioned clean table the same bounds are also stated on the
    partition column, so only the days in range are listed and read
    (partition pruning); Catalyst cannot derive that from ``opened`` alone."""
    sd, ed = parse_day(start), parse_day(end)
    prune = col == "opened" and PARTITION_DATE in df.columns
    if sd is not None:
        df = df.where(F.col(col) >= ts_lit(sd))
        if prune:
            df = df.where(F.col(PARTITION_DATE) >= F.lit(sd))
    if ed is not None:
        df = df.where(F.col(col) <= end_of_day(ed))
        if prune:
            df = df.where(F.col(PARTITION_DATE) <= F.lit(ed))
    return df


def filter_rollup_dates(df: DataFrame, start: str | None, end: str | None, col: str = "date") -> DataFrame:
    """P-05: inclusive ``date`` range on a daily rollup."""
    sd, ed = parse_day(start), parse_day(end)
    if sd is not None:
        df = df.where(F.col(col) >= F.lit(sd))
    if ed is not None:
        df = df.where(F.col(col) <= F.lit(ed))
    return df


def filter_rollup_months(df: DataFrame, start: str | None, end: str | None, col: str = "year_month") -> DataFrame:
    """P-06: keep a month when [first day, last day] overlaps [start, end]."""
    sd, ed = parse_day(start), parse_day(end)
    first = month_first(col)
    if sd is not None:
        df = df.where(F.last_day(first) >= F.lit(sd))
    if ed is not None:
        df = df.where(first <= F.lit(ed))
    return df


def days_in_range(start: str | None, end: str | None, as_of: dt.date | None = None) -> int | None:
    """P-07: whole days in the range; None when unbounded on both sides.

    A missing start means 2000-01-01, a missing end means ``as_of`` (the
    caller's "today"; never read from the clock inside tested code).
    """
    if not start and not end:
        return None
    try:
        sd = parse_day(start) if start else dt.date(2000, 1, 1)
        ed = parse_day(end) if end else (as_of or dt.date.today())
    except ValueError:
        return None         # no length; the filter that the bound goes to refuses it
    return max(0, (ed - sd).days)


def filter_category(df: DataFrame, category: str | None) -> DataFrame:
    """P-09 (category)."""
    return df if category is None else df.where(F.col("category") == category)


def filter_district(df: DataFrame, district: int | None, col: str = "district") -> DataFrame:
    """P-09 (district, compared numerically)."""
    if district is None:
        return df
    return df.where(F.col(col).try_cast("double") == float(district))


def valid_resolution(df: DataFrame) -> DataFrame:
    """P-12: both timestamps present and ``0 <= resolution_hours < 8760``."""
    return df.where(F.col("opened").isNotNull() & F.col("closed").isNotNull()
                    & (F.col("resolution_hours") >= 0) & (F.col("resolution_hours") < RESOLUTION_MAX_HOURS))


def recent_slice(df: DataFrame, days: int = 90, col: str = "opened") -> DataFrame:
    """P-13: rows with ``opened >= max(opened) - days``.

    ``max`` is a scalar subquery (one partial aggregate, its single value
    inlined into the filter), so no row ever meets another table.
    """
    if col == "opened" and PARTITION_DATE in df.columns:
        # the latest day is read off the partition column, and the slice is pruned by it
        last_day = df.select(F.max(PARTITION_DATE)).scalar()
        latest = df.where(F.col(PARTITION_DATE) == last_day).select(F.max(col)).scalar()
        df = df.where(F.col(PARTITION_DATE) >= F.date_sub(last_day, days))
    else:
        latest = df.select(F.max(col)).scalar()
    return df.where(F.col(col) >= F.timestamp_add("DAY", F.lit(-days), latest))

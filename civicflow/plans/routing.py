"""P-08: answer from raw rows or from a rollup, by the length of the date range.

The choice is a driver-side decision about *which DataFrame* to plan, made
from the query parameters only; each branch is then an ordinary lazy plan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RAW_CUTOFF_DAYS
from ..functions.calendar import year_month
from ..operators import filters


def use_rollup(start: str | None, end: str | None, as_of: dt.date | None = None,
               cutoff: int = RAW_CUTOFF_DAYS) -> bool:
    days = filters.days_in_range(start, end, as_of)
    return days is not None and days > cutoff


def _usable(rollup: DataFrame | None, check_empty: bool) -> bool:
    if rollup is None:
        return False
    return not (check_empty and rollup.isEmpty())


def daily_counts(raw: DataFrame, daily_rollup: DataFrame | None, start: str | None, end: str | None,
                 as_of: dt.date | None = None, category: str | None = None,
                 check_empty: bool = False) -> DataFrame:
    """(date, count) from ``daily_agg`` for long ranges, else from raw rows."""
    if use_rollup(start, end, as_of) and daily_rollup is not None:
        agg = filters.filter_category(filters.filter_rollup_dates(daily_rollup, start, end), category)
        if _usable(agg, check_empty):
            return agg.groupBy("date").agg(F.sum("count").cast("long").alias("count"))
    df = filters.filter_category(filters.filter_date_range(raw, start, end), category)
    return df.groupBy(F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def monthly_counts(raw: DataFrame, monthly_rollup: DataFrame | None, start: str | None, end: str | None,
                   as_of: dt.date | None = None, check_empty: bool = False) -> DataFrame:
    """(year_month, count) from ``monthly_agg`` (month-overlap filter) or raw rows."""
    if use_rollup(start, end, as_of) and monthly_rollup is not None:
        agg = filters.filter_rollup_months(monthly_rollup, start, end)
        if _usable(agg, check_empty):
            return agg.groupBy("year_month").agg(F.sum("count").cast("long").alias("count"))
    df = filters.filter_date_range(raw, start, end)
    return df.groupBy(year_month("opened").alias("year_month")).agg(F.count(F.lit(1)).alias("count"))


def period_total_source(start: str, end: str) -> str:
    """compare-periods routes each period on its own length (no missing-bound default)."""
    sd, ed = filters.parse_day(start), filters.parse_day(end)
    days = (ed - sd).days if sd and ed else 0
    return "rollup" if days > RAW_CUTOFF_DAYS else "raw"

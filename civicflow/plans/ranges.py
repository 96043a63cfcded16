"""P-08 for any range: whole months, whole days and edges, each from the table that holds it.

A range of instants is cut, on the driver and from its bounds alone, into the months that lie
inside it, the days that lie inside it but not in one of these months, and the parts of a day at its ends.
Months are answered from the monthly rollup, days from the daily rollup, and only the parts of a
day from raw rows; the counts add up.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import ts_lit, year_month
from ..operators import filters

Bound = str | dt.date | dt.datetime


@dataclass(frozen=True)
class RangeParts:
    """``months``: (first, last) first days of months, or None; ``days``: (first, last) runs of days;
    ``edges``: (from, to) instants, ``to`` not included."""
    months: tuple[dt.date, dt.date] | None
    days: tuple[tuple[dt.date, dt.date], ...]
    edges: tuple[tuple[dt.datetime, dt.datetime], ...]


def instant(bound: Bound, after: bool) -> dt.datetime:
    """A bound as an instant: a day means its beginning or, as an upper bound, its end; text may be a day in any
    form that ``filters.parse_day`` reads, or an ISO time."""
    if isinstance(bound, dt.datetime):
        return bound
    if isinstance(bound, str) and len(bound.strip()) > 10:
        try:
            return dt.datetime.fromisoformat(bound.strip())
        except ValueError:
            pass
    day = filters.parse_day(bound)
    if day is None:
        raise ValueError("a range needs both bounds")
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(days=int(after))


def _next_month(day: dt.date) -> dt.date:
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def split_range(start: Bound, end: Bound) -> RangeParts:
    """Cut [start, end) (a day as ``end``: with that day) into months, days and edges."""
    low, high = instant(start, False), instant(end, True)
    if low >= high:
        return RangeParts(None, (), ())
    first = low.date() if low.time() == dt.time() else low.date() + dt.timedelta(days=1)      # first whole day
    stop = high.date()                                                                       # day after the last whole one
    if first >= stop:                                            # no whole day inside
        midnight = dt.datetime.combine(first, dt.time())
        cut = [low, midnight, high] if low < midnight < high else [low, high]
        return RangeParts(None, (), tuple(zip(cut, cut[1:])))
    edges = [(a, b) for a, b in ((low, dt.datetime.combine(first, dt.time())), (dt.datetime.combine(stop, dt.time()), high)) if a < b]
    one = dt.timedelta(days=1)
    month = first if first.day == 1 else _next_month(first)      # first whole month
    after = stop.replace(day=1)                                  # month after the last whole one
    if month >= after:
        return RangeParts(None, ((first, stop - one),), tuple(edges))
    days = [(a, b - one) for a, b in ((first, month), (after, stop)) if a < b]
    return RangeParts((month, (after - one).replace(day=1)), tuple(days), tuple(edges))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _edge_rows(raw: DataFrame, parts: RangeParts) -> DataFrame:
    """Raw rows at the ends of a range; on a day-partitioned table only the days at the ends are listed."""
    near = [(F.col("opened") >= ts_lit(a)) & (F.col("opened") < ts_lit(b)) for a, b in parts.edges]
    rows = raw.where(_any(near))
    if filters.PARTITION_DATE in raw.columns:
        rows = rows.where(F.col(filters.PARTITION_DATE).isin([a.date() for a, _ in parts.edges]))
    return rows


def _sources(raw: DataFrame, daily: DataFrame, monthly: DataFrame | None, parts: RangeParts, keys: dict[str, tuple]) -> list[DataFrame]:
    """(keys, count) of each part. ``keys``: name -> its column in the monthly rollup, the daily one and raw rows."""
    def grouped(df: DataFrame, at: int, count: Column) -> DataFrame:
        return df.groupBy(*[cols[at].alias(k) for k, cols in keys.items()]).agg(count.cast("long").alias("count"))

    out, days = [], list(parts.days)
    if parts.months:
        first, last = parts.months
        if monthly is not None:
            inside = F.col("year_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}")
            out.append(grouped(monthly.where(inside), 0, F.sum("count")))
        else:
            days.append((first, _next_month(last) - dt.timedelta(days=1)))
    if days:
        inside = _any([F.col("date").between(F.lit(a), F.lit(b)) for a, b in days])
        out.append(grouped(daily.where(inside), 1, F.sum("count")))
    if parts.edges:
        out.append(grouped(_edge_rows(raw, parts), 2, F.count(F.lit(1))))
    if not out:
        out.append(grouped(raw.where("false"), 2, F.count(F.lit(1))))
    return out


def _added(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("count").alias("count"))


def range_counts(raw: DataFrame, daily: DataFrame, monthly: DataFrame, start: Bound, end: Bound,
                 keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """Requests in [start, end) by ``keys`` (of category and district): equal to counting raw rows."""
    same = {k: (F.col(k),) * 3 for k in keys}
    return _added(_sources(raw, daily, monthly, split_range(start, end), same), list(keys))


def range_daily(raw: DataFrame, daily: DataFrame, start: Bound, end: Bound) -> DataFrame:
    """(date, count) over [start, end): whole days from the rollup, parts of days from raw rows."""
    date = {"date": (None, F.col("date"), F.to_date("opened"))}
    return _added(_sources(raw, daily, None, split_range(start, end), date), ["date"])


def range_monthly(raw: DataFrame, daily: DataFrame, monthly: DataFrame, start: Bound, end: Bound) -> DataFrame:
    """(year_month, count) over [start, end): a month at an end counts its days inside the range only."""
    month = {"year_month": (F.col("year_month"), year_month(F.col("date")), year_month("opened"))}
    return _added(_sources(raw, daily, monthly, split_range(start, end), month), ["year_month"])

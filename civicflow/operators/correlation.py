"""Requests vs side tables: A-25 crime correlation, A-26 event-day lift,
A-27 top categories on event days, J-01 .. J-09.

Facts are first reduced to one row per day (partial aggregate); the joins
then run on day-grain tables whose size is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct_change, rnd
from . import filters


def daily_requests(req: DataFrame, start: str | None = None, end: str | None = None,
                   keys: list[str] | None = None) -> DataFrame:
    df = filters.filter_date_range(req, start, end)
    return df.groupBy(F.to_date("opened").alias("date"), *(keys or [])).agg(
        F.count(F.lit(1)).alias("total_requests"))


def with_event_flag(daily: DataFrame, events_agg: DataFrame) -> DataFrame:
    """J-01: left join on date; has_events = any count > 0, unmatched -> false."""
    ev = events_agg.select("date", (F.coalesce("event_count", F.lit(0)) + F.coalesce("street_closure_count", F.lit(0))
                                    + F.coalesce("construction_count", F.lit(0)) > 0).alias("has_events"))
    return daily.join(ev, "date", "left").withColumn("has_events", F.coalesce("has_events", F.lit(False)))


def split_event_days(daily: DataFrame, events_agg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-07: (event days, non-event days)."""
    flagged = with_event_flag(daily, events_agg)
    return flagged.where("has_events"), flagged.where("NOT has_events")


def event_lift(req: DataFrame, events_agg: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A-26: one row: event_days_avg_requests, non_event_days_avg_requests (1 dp), lift_percent, day counts."""
    flagged = with_event_flag(daily_requests(req, start, end), events_agg)
    agg = flagged.agg(
        F.avg(F.when(F.col("has_events"), F.col("total_requests"))).alias("ev"),
        F.avg(F.when(~F.col("has_events"), F.col("total_requests"))).alias("ne"),
        F.sum(F.col("has_events").cast("long")).alias("event_days_count"),
        F.sum((~F.col("has_events")).cast("long")).alias("non_event_days_count"))
    return agg.select(rnd("ev", 1).alias("event_days_avg_requests"), rnd("ne", 1).alias("non_event_days_avg_requests"),
                      pct_change(F.col("ev"), F.col("ne"), 1).alias("lift_percent"),
                      F.coalesce("event_days_count", F.lit(0)).alias("event_days_count"),
                      F.coalesce("non_event_days_count", F.lit(0)).alias("non_event_days_count"))


def top_categories_on_event_days(req: DataFrame, events_agg: DataFrame, k: int = 10,
                                 start: str | None = None, end: str | None = None) -> DataFrame:
    """A-27 / J-07: the event days' (date, category) counts, then the top-k categories by rows."""
    daily = daily_requests(req, start, end, ["category"])
    on_days, _ = split_event_days(daily, events_agg)
    c = on_days.groupBy("category").agg(F.sum("total_requests").alias("count"))
    return c.orderBy(F.desc("count"), "category").limit(k)


def daily_pairs(req: DataFrame, other_daily: DataFrame, value_col: str, keys: list[str] | None = None,
                start: str | None = None, end: str | None = None) -> DataFrame:
    """J-02 / J-09: inner join of daily requests with another day-keyed series on (date, *keys)."""
    a = daily_requests(req, start, end, keys)
    return a.join(other_daily.select("date", *(keys or []), value_col), ["date", *(keys or [])], "inner")


def correlation(req: DataFrame, other_daily: DataFrame, value_col: str = "incident_count",
                keys: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A-25: correlation (4 dp, null below 2 matched days), days_matched, avg_311, avg_incidents (1 dp)."""
    pairs = daily_pairs(req, other_daily, value_col, keys, start, end)
    a, b = F.col("total_requests").cast("double"), F.col(value_col).cast("double")
    agg = pairs.groupBy(*(keys or [])).agg(
        # Pearson r = cov / (sd_a * sd_b); try_divide -> null for a constant series (ANSI-safe)
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("r"),
        F.count(F.lit(1)).alias("days_matched"),
        F.avg("total_requests").alias("a"), F.avg(value_col).alias("b"))
    return agg.select(*(keys or []), F.when(F.col("days_matched") >= 2, rnd("r", 4)).alias("correlation"),
                      "days_matched", rnd("a", 1).alias("avg_311"), rnd("b", 1).alias("avg_incidents"))

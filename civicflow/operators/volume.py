"""Volume and calendar questions (A-11 .. A-17, A-22 .. A-24, A-30 .. A-33, A-39, A-40).

Pattern throughout: one partial aggregate over the facts down to a calendar
grain (day, hour, weekday, month), then joins/windows on that small result.
Windows without a partition key only ever run on such pre-aggregated rows
(<= days in the range, 24 hours, 7 weekdays, months in the range).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import WEEKDAY_NAMES
from ..functions.ordering import sort_small
from ..functions.calendar import end_of_day, ts_lit, year_month
from ..functions.numeric import pct, pct_change, ratio, rnd
from ..plans import routing
from . import filters


# ---------------------------------------------------------------- A-11 / W-11
def category_counts(req: DataFrame) -> DataFrame:
    """A-11: category -> count (value_counts order: count desc, category)."""
    return sort_small(req.groupBy("category").agg(F.count(F.lit(1)).alias("count")), F.desc("count"), "category")


def distinct_categories(req: DataFrame) -> DataFrame:
    """W-11."""
    return req.select("category").distinct()


def top_k(df: DataFrame, key: str, k: int, weight: str | None = None) -> DataFrame:
    """W-06: the k most frequent ``key`` values (ties: key ascending).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its local top-k, so only k rows per task move.
    """
    agg = df.groupBy(key).agg((F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("count"))
    return agg.orderBy(F.desc("count"), F.asc(key)).limit(k)


# ---------------------------------------------------------------- A-12 / A-13
def dataset_stats(req: DataFrame) -> DataFrame:
    """A-12: one row: total, first/last opened, daily_average, n_categories."""
    agg = req.agg(F.count(F.lit(1)).alias("total_requests"),
                  F.min("opened").alias("start"), F.max("opened").alias("end"),
                  F.count_distinct("category").alias("n_categories"))
    days = F.expr("timestampdiff(DAY, start, `end`)") + 1
    return agg.withColumn("daily_average",
                          rnd(F.col("total_requests") / F.greatest(days, F.lit(1)).cast("double"), 2))


def fetch_summary(req: DataFrame) -> DataFrame:
    """A-13: one row: total, date range, avg resolution (2 dp), missing_location."""
    return req.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("opened").alias("start"), F.max("opened").alias("end"),
        rnd(F.avg("resolution_hours"), 2).alias("avg_resolution_hours"),
        (F.sum(F.col("latitude").isNull().cast("long")) + F.sum(F.col("longitude").isNull().cast("long")))
        .alias("missing_location"))


# ---------------------------------------------------------------- A-14
def daily_timeseries(raw: DataFrame, daily_rollup: DataFrame | None, events_by_date: DataFrame | None,
                     weather: DataFrame | None, start: str | None = None, end: str | None = None,
                     as_of: dt.date | None = None, check_empty: bool = False) -> DataFrame:
    """A-14: date, count + same-day event names (pipe-joined) + weather for that day."""
    daily = routing.daily_counts(raw, daily_rollup, start, end, as_of, check_empty=check_empty)
    if events_by_date is not None:
        daily = daily.join(events_by_date.select("date", "event_names"), "date", "left")
    if weather is not None:
        daily = daily.join(weather.select("date", "precip_mm", "temp_max_c", "temp_min_c", "rain_day"), "date", "left")
    return sort_small(daily, "date")


# ---------------------------------------------------------------- A-15
def weekdays(spark) -> DataFrame:
    """7-row weekday dimension (Monday = 0)."""
    from ..sources.fixtures import literal_table
    return literal_table(spark, list(enumerate(WEEKDAY_NAMES)), ["day_of_week", "day_name"])


def day_of_week_profile(raw: DataFrame, daily_rollup: DataFrame | None = None, start: str | None = None,
                        end: str | None = None, as_of: dt.date | None = None,
                        check_empty: bool = False) -> DataFrame:
    """A-15: always 7 rows Mon..Sun: count (0-filled), percentage (1 dp) of all rows."""
    daily = routing.daily_counts(raw, daily_rollup, start, end, as_of, check_empty=check_empty)
    by_dow = daily.groupBy(F.weekday("date").alias("day_of_week")).agg(F.sum("count").cast("long").alias("count"))
    # both sides have <= 7 rows by construction; the preserved side streams and
    # the weekday counts are the broadcast build side of the left outer join
    out = weekdays(raw.sparkSession).join(F.broadcast(by_dow), "day_of_week", "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("long")))
    total = F.sum("count").over(Window.partitionBy())   # over 7 rows
    return sort_small(out.withColumn("percentage", F.coalesce(pct(F.col("count"), total, 1), F.lit(0.0))),
                      "day_of_week")


# ---------------------------------------------------------------- A-16 / A-30
def hourly_profile(req: DataFrame, start: str | None = None, end: str | None = None,
                   hourly_rollup: DataFrame | None = None) -> DataFrame:
    """A-16: hour, count, is_peak (highest count; ties -> lowest hour).

    The hour x weekday rollup has no date column, so it can answer only when
    no date filter applies; otherwise raw rows are read."""
    if hourly_rollup is not None and not start and not end:
        by_h = hourly_rollup.groupBy("hour").agg(F.sum("count").cast("long").alias("count"))
    else:
        df = filters.filter_date_range(req, start, end)
        by_h = df.groupBy(F.hour("opened").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("count"), "hour"))   # <= 24 rows
    return sort_small(by_h.withColumn("is_peak", rank == 1), "hour")


def peak_window_share(req: DataFrame, from_hour: int = 8, to_hour: int = 11) -> DataFrame:
    """A-30: hour, count, share (% of day, 1 dp), window_share (% in [from, to], 1 dp)."""
    by_h = req.groupBy(F.hour("opened").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    in_win = F.when(F.col("hour").between(from_hour, to_hour), F.col("count")).otherwise(0)
    return by_h.select("hour", "count",
                       pct(F.col("count"), F.sum("count").over(w), 1).alias("share"),
                       pct(F.sum(in_win).over(w), F.sum("count").over(w), 1).alias("window_share")).transform(
        lambda d: sort_small(d, "hour"))


# ---------------------------------------------------------------- A-17 / A-33
def monthly_trend(raw: DataFrame, monthly_rollup: DataFrame | None = None, start: str | None = None,
                  end: str | None = None, as_of: dt.date | None = None, check_empty: bool = False) -> DataFrame:
    """A-17: year_month, count, average (mean of the monthly counts, 0 dp).

    Answered from the rollup, a range that does not begin or end with a month
    covers its first and last month whole (P-06)."""
    m = routing.monthly_counts(raw, monthly_rollup, start, end, as_of, check_empty)
    return sort_small(m.withColumn("average", rnd(F.avg("count").over(Window.partitionBy()), 0)), "year_month")


def month_growth(req: DataFrame) -> DataFrame:
    """A-33: year_month, count, growth_pct vs the first month (1 dp)."""
    m = req.groupBy(year_month("opened").alias("year_month")).agg(F.count(F.lit(1)).alias("count"))
    base = F.first("count").over(Window.partitionBy().orderBy("year_month")
                                 .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sort_small(m.withColumn("growth_pct", pct_change(F.col("count"), base, 1)), "year_month")


# ---------------------------------------------------------------- A-22
def category_timeseries(req: DataFrame, category: str) -> DataFrame:
    """A-22: date, count for one category, plus totals as columns."""
    df = req.where(F.col("category") == category)
    d = df.groupBy(F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    return d.withColumns({"total_days": F.count(F.lit(1)).over(w),
                          "total_count": F.sum("count").over(w)}).transform(lambda x: sort_small(x, "date"))


# ---------------------------------------------------------------- A-23
def compare_periods(raw: DataFrame, daily_rollup: DataFrame | None, base_start: str, base_end: str,
                    compare_start: str | None = None, compare_end: str | None = None,
                    category: str | None = None) -> DataFrame:
    """A-23: one row: base_total, compare_total, change_percent (1 dp, null when compare is 0).

    Periods answered from the same source share one scan with conditional
    sums; a period longer than 90 days reads the daily rollup.
    """
    periods = [("base_total", base_start, base_end)]
    if compare_start and compare_end:
        periods.append(("compare_total", compare_start, compare_end))
    sums = {}
    for source in ("raw", "rollup"):
        mine = [p for p in periods if routing.period_total_source(p[1], p[2]) == source]
        if not mine:
            continue
        if source == "rollup" and daily_rollup is not None:
            df, when_col, weight = filters.filter_category(daily_rollup, category), F.col("date"), F.col("count")
            conds = {n: when_col.between(F.lit(filters.parse_day(s)), F.lit(filters.parse_day(e)))
                     for n, s, e in mine}
        else:
            df, weight = filters.filter_category(raw, category), F.lit(1)
            conds = {}
            for n, s, e in mine:
                sd, ed = filters.parse_day(s), filters.parse_day(e)
                conds[n] = F.col("opened").between(ts_lit(sd), end_of_day(ed))
                if filters.PARTITION_DATE in raw.columns:
                    conds[n] = conds[n] & F.col(filters.PARTITION_DATE).between(F.lit(sd), F.lit(ed))
        # the periods as a filter too: only their days reach the scan
        df = df.where(reduce(lambda a, b: a | b, conds.values()))
        one = df.agg(*[F.coalesce(F.sum(F.when(c, weight)), F.lit(0)).cast("long").alias(n)
                       for n, c in conds.items()])
        # long form (period, total) so sources combine by union, not by join
        sums[source] = one.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("period"), F.col(n).alias("total")) for n in conds])).alias("p")).select("p.*")
    long = None
    for part in sums.values():
        long = part if long is None else long.unionByName(part)
    row = long.agg(*[F.coalesce(F.sum(F.when(F.col("period") == n, F.col("total"))), F.lit(0)).cast("long").alias(n)
                     for n in ("base_total", "compare_total")])
    return row.select("base_total", "compare_total",
                      F.when(F.col("compare_total") > 0,
                             pct_change(F.col("base_total"), F.col("compare_total"), 1)).alias("change_percent"))


# ---------------------------------------------------------------- A-24
def freshness(tables: dict[str, DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """A-24: dataset, last_date = max(date) per date-keyed table; null for a table that is not there."""
    spark = spark or next(df for df in tables.values() if df is not None).sparkSession
    none = spark.range(1).select(F.lit(None).cast("date").alias("last_date"))
    parts = [(none if df is None else df.agg(F.max(F.col("date").cast("date")).alias("last_date"))).select(
        F.lit(name).alias("dataset"), "last_date") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- A-31 / A-32
def weekday_weekend(req: DataFrame) -> DataFrame:
    """A-31: per category and overall (category null): weekday_n, weekend_n, ratio (2 dp)."""
    wk = (F.weekday("opened") >= 5)
    out = req.rollup("category").agg(F.sum((~wk).cast("long")).alias("weekday_n"),
                                     F.sum(wk.cast("long")).alias("weekend_n"))
    return out.withColumn("ratio", rnd(ratio("weekday_n", "weekend_n"), 2))


def category_peak_hours(req: DataFrame, evening_from: int = 18) -> DataFrame:
    """A-32: category, peak_hour (count desc, hour asc), peak_count, evening_share (% at >= 18h, 1 dp)."""
    by = req.groupBy("category", F.hour("opened").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category")
    rn = F.row_number().over(w.orderBy(F.desc("n"), "hour"))
    ev = F.sum(F.when(F.col("hour") >= evening_from, F.col("n")).otherwise(0)).over(w)
    return (by.withColumns({"rn": rn, "evening_share": pct(ev, F.sum("n").over(w), 1)})
            .where("rn = 1").select("category", F.col("hour").alias("peak_hour"), F.col("n").alias("peak_count"),
                                    "evening_share"))


# ---------------------------------------------------------------- A-39 / A-40
def weekday_baseline(req: DataFrame) -> DataFrame:
    """A-39: day_of_week, avg_daily (mean count over days having rows, 1 dp), n_days."""
    daily = req.groupBy(F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    return (daily.groupBy(F.weekday("date").alias("day_of_week"))
            .agg(rnd(F.avg("count"), 1).alias("avg_daily"), F.count(F.lit(1)).alias("n_days"))
            .transform(lambda d: sort_small(d, "day_of_week")))


def week_over_week(req: DataFrame) -> DataFrame:
    """A-40: category, week (Monday), count, wow_pct vs the previous week with rows (1 dp)."""
    wk = F.to_date(F.date_trunc("week", "opened")).alias("week")
    c = req.groupBy("category", wk).agg(F.count(F.lit(1)).alias("count"))
    prev = F.lag("count").over(Window.partitionBy("category").orderBy("week"))
    return c.withColumn("wow_pct", pct_change(F.col("count"), prev, 1))

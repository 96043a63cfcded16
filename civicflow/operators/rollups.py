"""Rollup builders A-01 .. A-07 over clean requests.

All are hash aggregates with partial (map-side) combine, so a hot category or
day is reduced on the map side before the shuffle. ``drop_null_keys=True``
reproduces the reference, whose grouping silently drops rows without a
district; the default keeps them so the rollup answer equals the raw answer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sort_small
from ..functions.calendar import ts_lit, year_month
from ..functions.geo import cell_id, in_box
from ..functions.numeric import rnd
from ..session import materialize
from . import filters
from .selection import exact_median


def _keys(df: DataFrame, keys: list[str], drop_null_keys: bool) -> DataFrame:
    if not drop_null_keys:
        return df
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def daily_agg(req: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    """A-01: (date, category, district) -> count, avg_resolution_hours (2 dp)."""
    df = _keys(req.withColumn("date", F.to_date("opened")), ["date", "category", "district"], drop_null_keys)
    return df.groupBy("date", "category", "district").agg(
        F.count(F.lit(1)).alias("count"),
        rnd(F.avg("resolution_hours"), 2).alias("avg_resolution_hours"))


def monthly_agg(req: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    """A-02: (year_month, category, district) -> count."""
    df = _keys(req.withColumn("year_month", year_month("opened")), ["year_month", "category", "district"],
               drop_null_keys)
    return df.groupBy("year_month", "category", "district").agg(F.count(F.lit(1)).alias("count"))


def grid_agg(req: DataFrame) -> DataFrame:
    """A-03: (lat_cell, lon_cell, category, year_month) -> count, closed box, truncating snap.

    Also carries the integer cell ids, a stable key for joins.
    """
    df = req.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                   & in_box("latitude", "longitude", inclusive=True))
    df = df.select(cell_id("latitude").alias("lat_id"), cell_id("longitude").alias("lon_id"),
                   "category", year_month("opened").alias("year_month"))
    agg = df.groupBy("lat_id", "lon_id", "category", "year_month").agg(F.count(F.lit(1)).alias("count"))
    return agg.select((F.col("lat_id") * F.lit(0.01)).alias("lat_cell"),
                      (F.col("lon_id") * F.lit(0.01)).alias("lon_cell"),
                      "category", "year_month", "count", "lat_id", "lon_id")


def hourly_agg(req: DataFrame) -> DataFrame:
    """A-04: (hour, day_of_week Mon=0, category) -> count."""
    return (req.select(F.hour("opened").alias("hour"), F.weekday("opened").alias("day_of_week"), "category")
            .groupBy("hour", "day_of_week", "category").agg(F.count(F.lit(1)).alias("count")))


def resolution_micros(req: DataFrame) -> DataFrame:
    return req.withColumn("res_us", F.expr("timestampdiff(MICROSECOND, opened, closed)"))


def resolution_agg(req: DataFrame, exact: bool = True) -> DataFrame:
    """A-05: (category, year_month) -> avg_hours, median_hours (exact), count; hours > 0."""
    df = resolution_micros(req).where(F.col("resolution_hours").isNotNull() & (F.col("resolution_hours") > 0))
    keys = ["category", "year_month"]
    # multi-pass (mean + exact median): materialise the 3-column projection once
    df = materialize(df.select("category", year_month("opened").alias("year_month"), "res_us"))
    df = df.withColumn("resolution_hours", F.col("res_us") / F.lit(3.6e9))
    stats = df.groupBy(*keys).agg(F.avg("resolution_hours").alias("avg_h"), F.count(F.lit(1)).alias("count"))
    if exact:
        med = exact_median(df, keys, "res_us").select(*keys, (F.col("median") / F.lit(3.6e9)).alias("med_h"))
    else:
        med = df.groupBy(*keys).agg(F.percentile_approx("resolution_hours", 0.5, 10000).alias("med_h"))
    out = stats.join(med, keys, "inner")
    return out.select(*keys, rnd("avg_h", 2).alias("avg_hours"), rnd("med_h", 2).alias("median_hours"),
                      "count")


def recent_raw(req: DataFrame, days: int = 90) -> DataFrame:
    """Rows within ``days`` of the latest opened time (P-13)."""
    return filters.recent_slice(req, days)


def recent_by_category(req: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """A-06: last ``days`` before ``as_of``: category, date, count, avg resolution; date desc, count desc."""
    since = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days)
    df = req.where(F.col("opened") >= ts_lit(since))
    if filters.PARTITION_DATE in req.columns:
        df = df.where(F.col(filters.PARTITION_DATE) >= F.lit(since.date()))
    df = df.withColumn("date", F.to_date("opened"))
    out = df.groupBy("category", "date").agg(F.count(F.lit(1)).alias("request_count"),
                                             rnd(F.avg("resolution_hours"), 2).alias("avg_resolution_hours"))
    return sort_small(out, F.col("date").desc(), F.col("request_count").desc(), "category")


def daily_aggregates(req: DataFrame) -> DataFrame:
    """A-07: (date, category) -> total_requests, avg_resolution_hours, neighborhood_count, weekend.

    Counts neighborhoods; a table without that column has districts counted instead."""
    area = "neighborhood" if "neighborhood" in req.columns else "district"
    df = req.withColumn("date", F.to_date("opened"))
    return df.groupBy("date", "category").agg(
        F.count(F.lit(1)).alias("total_requests"),
        rnd(F.avg("resolution_hours"), 2).alias("avg_resolution_hours"),
        F.count_distinct(area).alias("neighborhood_count"),
    ).withColumn("weekend", F.weekday("date") >= 5)


# ------------------------------------------------ A-01, A-02, A-04 and A-07 from one scan
def hour_cube(req: DataFrame) -> DataFrame:
    """The finest grain that the calendar rollups share: (date, hour, category, district, area) -> count and the sum
    and number of resolution hours. One partial aggregate over the requests; each rollup is an aggregate
    of it, so the requests are read once however many rollups there are."""
    area = F.col("neighborhood" if "neighborhood" in req.columns else "district")
    return (req.groupBy(F.to_date("opened").alias("date"), F.hour("opened").alias("hour"), "category", "district", area.alias("area"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum("resolution_hours").alias("hours"),
                 F.count("resolution_hours").alias("resolved")))


def _mean_hours() -> Column:
    return rnd(F.try_divide(F.sum("hours"), F.sum("resolved").cast("double")), 2).alias("avg_resolution_hours")


def daily_of_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy("date", "category", "district").agg(F.sum("count").alias("count"), _mean_hours())


def monthly_of_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy(year_month("date").alias("year_month"), "category", "district").agg(F.sum("count").alias("count"))


def hourly_of_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy("hour", F.weekday("date").alias("day_of_week"), "category").agg(F.sum("count").alias("count"))


def daily_aggregates_of_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy("date", "category").agg(
        F.sum("count").alias("total_requests"), _mean_hours(), F.count_distinct("area").alias("neighborhood_count"),
    ).withColumn("weekend", F.weekday("date") >= 5)


# ------------------------------------------------ A-07 / A-12: distinct counts over any span
SKETCH_LG = 12      # 4,096 registers: a relative standard error of about 1.6 %, exact for a few hundred values


def daily_sketches(req: DataFrame, *cols: str) -> DataFrame:
    """(date, category) -> count and a mergeable distinct-count sketch of each of ``cols`` (``<col>_sketch``):
    a bounded number of bytes for each, however many values it has seen."""
    return req.groupBy(F.to_date("opened").alias("date"), "category").agg(
        F.count(F.lit(1)).alias("count"), *[F.hll_sketch_agg(c, F.lit(SKETCH_LG)).alias(f"{c}_sketch") for c in cols])


def span_distinct(sketches: DataFrame, cols: tuple[str, ...], keys: tuple[str, ...] = ("category",),
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Requests and distinct values of ``cols`` over [start, end] by ``keys`` (of date and category), from
    the daily sketches: daily distinct counts don't add up, their sketches do."""
    rows = filters.filter_rollup_dates(sketches, start, end)
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"), *[
        F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_distinct") for c in cols])


OF_CUBE = {"daily_agg": daily_of_cube, "monthly_agg": monthly_of_cube, "hourly_agg": hourly_of_cube,
           "daily_aggregates": daily_aggregates_of_cube}

ROLLUPS = {
    "daily_agg": daily_agg,
    "monthly_agg": monthly_agg,
    "grid_agg": grid_agg,
    "hourly_agg": hourly_agg,
    "resolution_agg": resolution_agg,
    "recent_raw": recent_raw,
}

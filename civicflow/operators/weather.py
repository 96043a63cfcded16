"""A-18 weather impact and P-19 weather lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sort_small
from ..functions.numeric import pct_change, rnd
from . import filters
from .normalize import sanitize


def with_rain(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Attach is_rainy by date to per-day rows (days without weather are dropped, like NaN flags)."""
    w = weather.select("date", (F.col("rain_day") == 1).alias("is_rainy"))
    return daily.join(w, "date", "inner")


def weather_impact(req: DataFrame, weather: DataFrame, top: int = 10) -> DataFrame:
    """A-18: overall row (category null) + top-``top`` categories.

    rainy_avg / dry_avg = mean daily rows over days of that class having rows;
    impact_percent = (rainy / dry - 1) * 100 (1 dp); sorted by |impact| desc.
    """
    per_day = with_rain(req.groupBy("category", F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("n")),
                        weather)
    overall_day = per_day.groupBy("date", "is_rainy").agg(F.sum("n").alias("n"))
    top_cats = (per_day.groupBy("category").agg(F.sum("n").alias("c"))
                .orderBy(F.desc("c"), "category").limit(top).select("category"))
    cat_day = per_day.join(F.broadcast(top_cats), "category", "left_semi")   # <= top rows

    def summarise(d: DataFrame, keys: list[str]) -> DataFrame:
        return d.groupBy(*keys).agg(F.avg(F.when(F.col("is_rainy"), F.col("n"))).alias("rainy"),
                                    F.avg(F.when(~F.col("is_rainy"), F.col("n"))).alias("dry"))

    overall = summarise(overall_day, []).withColumn("category", F.lit(None).cast("string"))
    cats = summarise(cat_day, ["category"])
    # a category needs a dry day to compare with; the overall row is always there, its impact then 0
    both = cats.where(F.col("category").isNotNull() & (F.col("dry") > 0) & F.col("rainy").isNotNull()).withColumn(
        "impact_percent", pct_change(F.col("rainy"), F.col("dry"), 1)).unionByName(overall.withColumn(
            "impact_percent", F.coalesce(pct_change(F.col("rainy"), F.col("dry"), 1), F.lit(0.0))))
    out = both.select("category", rnd("rainy", 0).alias("rainy_day_avg"), rnd("dry", 0).alias("dry_day_avg"),
                      "impact_percent")
    return sort_small(out,
                      F.col("category").isNotNull(), F.desc(F.abs("impact_percent")), "category")


def weather_lookup(weather: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """P-19: date, precip_mm, temp_max_c, temp_min_c, rain_day for a date range, sorted; NaN is null (P-15)."""
    return filters.filter_rollup_dates(weather, start, end).select(
        "date", "precip_mm", "temp_max_c", "temp_min_c", "rain_day").transform(sanitize).orderBy("date")

"""One method per data endpoint of the reference service.

``RequestAnalytics`` holds the clean request table and the written rollups
(S-02: whichever of the ten named tables exist) and answers each question
with the same routing as the reference: long ranges from rollups, short or
undated ones from raw rows. Every method returns a lazy DataFrame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RAW_CUTOFF_DAYS
from ..operators import (anomaly, correlation, district, events, filters, forecast, geo, insights, normalize,
                         resolution, rollups, seasonal, volume, weather)
from ..sources import fixtures, sinks
from ..sources.tables import read_tables
from . import ranges, routing

#: The spans a trend can be asked for.
TIMEFRAMES = {"7d": 7, "30d": 30, "90d": 90}
ROLLUP_NAMES = ["daily_agg", "monthly_agg", "grid_agg", "hourly_agg", "resolution_agg", "recent_raw",
                "events_agg", "events_by_date", "crime_agg", "weather_agg"]


class RequestAnalytics:
    def __init__(self, spark: SparkSession, requests: DataFrame, rollups: dict[str, DataFrame] | None = None,
                 as_of: dt.date | None = None):
        self.spark = spark
        self.requests = requests
        self.rollups = rollups or {}
        self.as_of = as_of

    @classmethod
    def from_paths(cls, spark: SparkSession, requests_path: str, rollup_dir: str,
                   as_of: dt.date | None = None) -> "RequestAnalytics":
        """S-02: read the clean table and every rollup present under ``rollup_dir``."""
        return cls(spark, spark.read.parquet(requests_path), read_tables(spark, rollup_dir, ROLLUP_NAMES), as_of)

    def _r(self, name: str) -> DataFrame | None:
        return self.rollups.get(name)

    def _weather(self) -> DataFrame | None:
        return self._r("weather_agg")

    def range_counts(self, start: ranges.Bound, end: ranges.Bound, keys: tuple[str, ...] = ("category",)) -> DataFrame:
        """P-08: requests in any range by category or district, inside months and days from the rollups."""
        daily, monthly = self._r("daily_agg"), self._r("monthly_agg")
        if daily is None:
            daily = rollups.daily_agg(self.requests)
        if monthly is None:
            monthly = rollups.monthly_agg(self.requests)
        return ranges.range_counts(self.requests, daily, monthly, start, end, keys)

    # -------------------------------------------------------------- data
    def categories(self) -> DataFrame:                                   # /api/categories
        return volume.category_counts(self.requests)

    def recent(self, limit: int = 100) -> DataFrame:                     # /api/data/recent
        return normalize.recent_rows(self.requests, limit)

    def stats(self) -> DataFrame:                                        # /api/data/stats
        return volume.dataset_stats(self.requests)

    def top_categories(self, k: int = 10) -> DataFrame:
        return volume.top_k(self.requests, "category", k)

    def export(self, path: str, start: str | None = None, end: str | None = None) -> None:   # /api/data/export
        sinks.export_csv(self.requests, path, start, end)

    def daily_timeseries(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return volume.daily_timeseries(self.requests, self._r("daily_agg"), self._r("events_by_date"),
                                       self._weather(), start, end, self.as_of, check_empty=True)

    def weather(self, start: str | None = None, end: str | None = None) -> DataFrame:   # /api/data/weather
        w = self._weather()
        return None if w is None else weather.weather_lookup(w, start, end)

    def freshness(self) -> DataFrame:                                    # /api/data/freshness
        named = {"311": "daily_agg", "events": "events_agg", "crime": "crime_agg", "weather": "weather_agg"}
        return volume.freshness({k: self._r(v) for k, v in named.items()}, self.spark)

    # -------------------------------------------------------------- analytics
    def day_of_week(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return volume.day_of_week_profile(self.requests, self._r("daily_agg"), start, end, self.as_of, check_empty=True)

    def hourly_pattern(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return volume.hourly_profile(self.requests, start, end, self._r("hourly_agg"))

    def weather_impact(self) -> DataFrame:
        w = self._weather()
        return None if w is None else weather.weather_impact(self.requests, w)

    def monthly_trends(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return volume.monthly_trend(self.requests, self._r("monthly_agg"), start, end, self.as_of, check_empty=True)

    def category_insights(self) -> tuple[DataFrame, DataFrame]:
        return insights.category_growth(self.requests), district.district_concentration(self.requests)

    def events_by_date(self, start: str | None = None, end: str | None = None) -> DataFrame:
        e = self._r("events_by_date")
        return None if e is None else events.names_list(filters.filter_rollup_dates(e, start, end)).orderBy("date")

    def event_correlation(self, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
        e = self._r("events_agg")
        if e is None:
            return None, None
        return (correlation.event_lift(self.requests, e, start, end),
                correlation.top_categories_on_event_days(self.requests, e, 10, start, end))

    def correlation(self, dataset: str = "events", start: str | None = None, end: str | None = None):
        if dataset == "crime":
            c = self._r("crime_agg")
            return None if c is None else correlation.correlation(self.requests, events.crime_daily(c),
                                                                  "incident_count", None, start, end)
        if dataset == "events":
            return self.event_correlation(start, end)
        raise ValueError(f"no such dataset to correlate with: {dataset!r}")

    def district_breakdown(self) -> DataFrame:
        return district.district_breakdown(self.requests, fixtures.districts(self.spark))

    def resolution_time(self) -> tuple[DataFrame, DataFrame]:
        return resolution.resolution_overall(self.requests), resolution.resolution_by_category(self.requests)

    def resolution_by_hour_opened(self) -> DataFrame:
        return resolution.resolution_by_hour(self.requests)

    def anomalies(self) -> DataFrame:
        return anomaly.anomalies(self.requests, self._r("events_by_date"))

    def map_data(self, start: str | None = None, end: str | None = None, fmt: str = "points",
                 category: str | None = None, district_id: int | None = None) -> DataFrame:
        """Heatmap from the grid rollup when asked for or when the range exceeds 90 days
        and the rollup has cells in it; otherwise points, from the clean rows or,
        where those have none in range, from ``recent_raw``."""
        days = filters.days_in_range(start, end, self.as_of)
        grid = self._r("grid_agg")
        if (fmt == "heatmap" or (days is not None and days > RAW_CUTOFF_DAYS)) and grid is not None:
            if not filters.filter_category(filters.filter_rollup_months(grid, start, end), category).isEmpty():
                return geo.map_heatmap(grid, start, end, category)
        points = geo.map_points(self.requests, start, end, category, district_id)
        recent = self._r("recent_raw")
        if recent is not None and filters.filter_date_range(self.requests, start, end).isEmpty():
            return geo.map_points(recent, start, end, category, district_id)
        return points

    def compare_periods(self, base_start: str, base_end: str, compare_start: str | None = None,
                        compare_end: str | None = None, category: str | None = None) -> DataFrame:
        return volume.compare_periods(self.requests, self._r("daily_agg"), base_start, base_end,
                                      compare_start, compare_end, category)

    def category_timeseries(self, category: str) -> DataFrame:
        return volume.category_timeseries(self.requests, category)

    # -------------------------------------------------------------- predictions
    def _model(self):
        return forecast.fit_trend_weekday(forecast.daily_volumes(self.requests))

    def predict_volume(self, category: str, days: int = 7, start: dt.date | None = None,
                       model: str = "trend_weekday", model_path: str | None = None) -> DataFrame:
        """M-05 from the trend model, from the regression with a yearly season, or from trees that ``forecast.save_gbt`` wrote to ``model_path``."""
        if not 1 <= int(days) <= 30:
            raise ValueError("days must be between 1 and 30")
        start = start or self.as_of or dt.date.today()
        if model == "gbt":
            trees, meta = forecast.load_gbt(self.spark, model_path)
            return forecast.forecast_gbt(trees, forecast.daily_volumes(self.requests),
                                         meta.where(F.col("category") == category), start, days)
        if model == "seasonal":
            own = forecast.daily_volumes(filters.filter_category(self.requests, category))
            return seasonal.forecast_seasonal(seasonal.fit_seasonal(own), start, days)
        if model != "trend_weekday":
            raise ValueError(f"no such model: {model!r}")
        model, effects = self._model()
        return forecast.forecast(model.where(F.col("category") == category), effects, start, days)

    def predict_trends(self, category: str = "all", timeframe: str = "30d", start: dt.date | None = None,
                       first: int = 5) -> DataFrame:
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"timeframe must be one of {', '.join(TIMEFRAMES)}")
        days = TIMEFRAMES[timeframe]
        model, effects = self._model()
        if category != "all":
            model = model.where(F.col("category") == category)
        else:
            top = volume.top_k(self.requests, "category", first).select("category")
            model = model.join(F.broadcast(top), "category", "left_semi")       # <= first rows
        start = start or self.as_of or dt.date.today()
        return forecast.trend_summary(forecast.forecast(model, effects, start, days))

    def predict_hotspots(self, date: str | None = None, top_n: int = 10) -> DataFrame:
        """The busiest cells, of the month of ``date`` when one is given."""
        grid = self._r("grid_agg")
        from ..operators import rollups
        return geo.hotspots(grid if grid is not None else rollups.grid_agg(self.requests), date, date, top_n)


def routes_to_rollup(start: str | None, end: str | None, as_of: dt.date | None = None) -> bool:
    return routing.use_rollup(start, end, as_of)

"""Lazy building blocks shared by the registered queries.

A ``Ctx`` only *declares* DataFrames (fixture views, normalised side tables,
rollups) on first use; nothing is computed until the caller's action.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import events as ev
from ..operators import rollups
from ..sources import fixtures, landing

SEQ = ["l_orderkey", "l_linenumber", "l_partkey"]

# Fixed query parameters of the registered queries.
LONG_RANGE = ("1996-01-01", "1998-12-31")      # > 90 days: answered from rollups
SHORT_RANGE = ("1997-03-01", "1997-04-30")     # <= 90 days: answered from raw rows
SHORT_FIXTURE_RANGE = ("2024-01-08", "2024-01-21")
AS_OF_LONG = dt.date(2001, 8, 1)


class Ctx:
    """Declared views for one (session, data folder): lazy plans, each declared at most
    once per query. Nothing is kept between queries, so a table that was
    written anew in between is listed anew."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # fact views -----------------------------------------------------------
    @cached_property
    def short(self) -> DataFrame:
        return fixtures.requests_short(self.spark, self.sf_dir)

    @cached_property
    def long(self) -> DataFrame:
        return fixtures.requests_long(self.spark, self.sf_dir)

    # side tables ----------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return landing.normalize_events(fixtures.event_src(self.spark, self.sf_dir), SEQ)

    @cached_property
    def closures(self) -> DataFrame:
        return landing.normalize_closures(fixtures.closure_src(self.spark, self.sf_dir), SEQ)

    @cached_property
    def permits(self) -> DataFrame:
        return landing.normalize_permits(fixtures.permit_src(self.spark, self.sf_dir), SEQ)

    @cached_property
    def crime(self) -> DataFrame:
        return landing.normalize_crime(fixtures.crime_src(self.spark, self.sf_dir))

    @cached_property
    def weather(self) -> DataFrame:
        return fixtures.weather(self.spark, self.sf_dir)

    @cached_property
    def districts(self) -> DataFrame:
        return fixtures.districts(self.spark)

    # rollups --------------------------------------------------------------
    @cached_property
    def daily_long(self) -> DataFrame:
        return rollups.daily_agg(self.long)

    @cached_property
    def monthly_long(self) -> DataFrame:
        return rollups.monthly_agg(self.long)

    @cached_property
    def events_agg(self) -> DataFrame:
        return ev.events_agg(self.events, self.closures, self.permits)

    @cached_property
    def events_by_date(self) -> DataFrame:
        return ev.events_by_date(self.events, self.closures, self.permits)

    @cached_property
    def crime_agg(self) -> DataFrame:
        return ev.crime_agg(self.crime)

    @cached_property
    def trend_model(self) -> tuple[DataFrame, DataFrame]:
        """M-04 fitted on every day of ``requests_long`` (lazy plans)."""
        from ..operators import forecast
        return forecast.fit_trend_weekday(forecast.daily_volumes(self.long))

"""Registered queries: tables written under ``spark.checkpoint.dir`` and read back, and
the remaining inputs of the normalisers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlation, events, filters, forecast, normalize, rollups
from ..session import checkpoint_dir
from ..sources import fixtures, sinks
from ..sources.tables import read_tables
from .catalog import ORACLE, query
from .context import SHORT_FIXTURE_RANGE, Ctx
from .oracle_views import with_views as W
from .q_model import FC_START, _model
from .q_side import EVENT_DAY

FS, FE = SHORT_FIXTURE_RANGE


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sinks/{uuid.uuid4().hex}"


@query("s02_rollup_set", W("""
SELECT 'daily_agg' AS rollup, count(*) AS rows FROM (SELECT DISTINCT CAST(opened AS DATE), category, district FROM rl)
UNION ALL SELECT 'monthly_agg', count(*) FROM (SELECT DISTINCT strftime(opened, '%Y-%m'), category, district FROM rl)""", "rl"))
def s02_rollup_set(spark, sf_dir):
    """Two of the named rollups are there; the third is skipped."""
    c, folder = Ctx(spark, sf_dir), _folder(spark)
    sinks.write_parquet(c.daily_long, f"{folder}/daily_agg.parquet")
    sinks.write_parquet(c.monthly_long, f"{folder}/monthly_agg.parquet")
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("rollup"), "rows")
             for name, df in read_tables(spark, folder, ["daily_agg", "monthly_agg", "hourly_agg"]).items()]
    return parts[0].unionByName(parts[1])


@query("s06_gzip_parquet", ORACLE["a02_monthly_agg"])
def s06_gzip_parquet(spark, sf_dir):
    path = _folder(spark)
    sinks.write_parquet(Ctx(spark, sf_dir).monthly_long, path, ["year_month"])
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return back.select(F.col("year_month").cast("string").alias("year_month"), "category", "district", "count")


@query("s07_csv_export", W(f"""
SELECT case_id, CAST(opened AS DATE) AS day, category FROM rs
WHERE opened >= TIMESTAMP '{FS} 00:00:00' AND opened <= TIMESTAMP '{FE} 23:59:59'""", "rs"))
def s07_csv_export(spark, sf_dir):
    path = _folder(spark)
    sinks.export_csv(Ctx(spark, sf_dir).short, path, FS, FE)
    back = spark.read.option("header", True).csv(path)
    return back.select("case_id", F.to_date(F.left("opened", F.lit(10))).alias("day"), "category")


@query("s08_warehouse_append", W("""
SELECT CAST(opened AS DATE) AS opened_date, category, 2 * count(*) AS count FROM rs GROUP BY ALL""", "rs"))
def s08_warehouse_append(spark, sf_dir):
    """Two loads append; the second brings a new column."""
    path, req = _folder(spark), Ctx(spark, sf_dir).short
    sinks.warehouse_append(req, path)
    sinks.warehouse_append(req.withColumn("neighborhood", F.lit("x")), path)
    back = sinks.read_warehouse(spark, path)
    return back.groupBy("opened_date", "category").agg(F.count(F.lit(1)).alias("count"))


@query("s09_predictions_written", ORACLE["m08_predictions_table"])
def s09_predictions_written(spark, sf_dir):
    path = _folder(spark)
    model, effects = _model(Ctx(spark, sf_dir))
    table = forecast.predictions_table(forecast.forecast(model, effects, FC_START, 30), "trend_weekday", "v1",
                                       dt.datetime(2001, 8, 1))
    sinks.write_predictions(table, path)
    return spark.read.schema(table.schema).parquet(path).select(*table.columns)


@query("s10_incremental_refresh", W("""
SELECT date, count(*) * CASE WHEN date >= DATE '2024-01-15' THEN 10 ELSE 1 END AS count
FROM (SELECT CAST(opened AS DATE) AS date FROM rs) GROUP BY date""", "rs"))
def s10_incremental_refresh(spark, sf_dir):
    """The last days come again with other counts; the days before them stay."""
    path = _folder(spark)
    daily = Ctx(spark, sf_dir).short.groupBy(F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    sinks.refresh_partitions(daily, path)
    sinks.refresh_recent(daily.withColumn("count", F.col("count") * 10), path, dt.date(2024, 1, 31), 16)
    return spark.read.parquet(path).select(F.col("date").cast("date").alias("date"), "count")


@query("p15_sanitize", W("""
SELECT case_id, CASE WHEN CAST(case_id AS BIGINT) % 7 < 2 THEN NULL ELSE latitude END AS latitude, longitude FROM rs""", "rs"))
def p15_sanitize(spark, sf_dir):
    n = F.col("case_id").cast("long") % 7
    bad = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("-inf"))).otherwise(F.col("latitude"))
    return normalize.sanitize(Ctx(spark, sf_dir).short.select("case_id", bad.alias("latitude"), "longitude"))


_COORDS = """
SELECT service_request_id, latitude, longitude FROM portal_clean"""


def _by_columns(spark: SparkSession, sf_dir: str, lon: str) -> DataFrame:
    """The portal records with their coordinates as text in two columns."""
    p = fixtures.portal_requests(spark, sf_dir)
    flat = p.withColumns({"lat": F.col("point.coordinates")[1].cast("string"),
                          lon: F.col("point.coordinates")[0].cast("string")}).drop("point")
    return normalize.normalize_requests(flat).select("service_request_id", "latitude", "longitude")


@query("p11_lat_long_columns", W(_COORDS, "portal_clean"))
def p11_lat_long_columns(spark, sf_dir):
    return _by_columns(spark, sf_dir, "long")


@query("p11_lat_lon_columns", W(_COORDS, "portal_clean"))
def p11_lat_lon_columns(spark, sf_dir):
    return _by_columns(spark, sf_dir, "lon")


@query("j07_event_day_split", W(f"""
SELECT CASE WHEN has_events THEN 'event days' ELSE 'other days' END AS class, count(*) AS days,
       CAST(sum(total_requests) AS BIGINT) AS requests
FROM (SELECT d.total_requests, coalesce({EVENT_DAY}, false) AS has_events
      FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS total_requests FROM rl GROUP BY 1) d
      LEFT JOIN events_agg e ON d.date = e.date) GROUP BY 1""", "rl", "events_agg"))
def j07_event_day_split(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    parts = correlation.split_event_days(correlation.daily_requests(c.long), c.events_agg)
    one, two = [p.groupBy(F.lit(name).alias("class")).agg(F.count(F.lit(1)).alias("days"), F.sum("total_requests").alias("requests"))
                for name, p in zip(("event days", "other days"), parts)]
    return one.unionByName(two)


@query("p18_event_names_list", W("""
SELECT date, [trim(x) FOR x IN string_split(event_names, '|') IF trim(x) <> ''] AS names
FROM events_by_date WHERE date >= DATE '1997-01-01' AND date <= DATE '1997-06-30'""", "events_by_date"))
def p18_event_names_list(spark, sf_dir):
    return events.names_list(filters.filter_rollup_dates(Ctx(spark, sf_dir).events_by_date, "1997-01-01", "1997-06-30"))


@query("a07_daily_neighborhoods", W("""
SELECT CAST(opened AS DATE) AS date, category, count(*) AS total_requests,
       round(avg(resolution_hours), 2) AS avg_resolution_hours, count(DISTINCT district % 4) AS neighborhood_count,
       isodow(CAST(opened AS DATE)) >= 6 AS weekend
FROM rl GROUP BY ALL""", "rl"))
def a07_daily_neighborhoods(spark, sf_dir):
    """A table that names neighborhoods has those counted, not its districts."""
    return rollups.daily_aggregates(Ctx(spark, sf_dir).long.withColumn("neighborhood", F.col("district") % 4))

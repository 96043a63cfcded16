"""Registered queries: cleaning, row filters, sources and sink metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.geo import cell_id, cell_origin, in_box
from ..operators import filters, normalize, rollups
from ..session import checkpoint_dir
from ..sources import fixtures, landing, sinks
from ..sources.landed_records import read_landed
from .catalog import query
from .context import Ctx
from .oracle_views import with_views as W

CLEAN_COLS = ["service_request_id", "opened", "closed", "category", "district", "latitude", "longitude",
              "resolution_hours"]


def _portal(c: Ctx):
    return fixtures.portal_requests(c.spark, c.sf_dir)


@query("p01_normalize_portal", W("""
SELECT service_request_id, opened, closed, category, district, latitude, longitude, resolution_hours
FROM portal_clean""", "portal_clean"))
def p01_normalize_portal(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return normalize.normalize_requests(_portal(c)).select(*CLEAN_COLS)


@query("p02_clean_fetched", W("""
SELECT service_request_id, opened, closed, category, CAST(TRY_CAST(supervisor_district AS DOUBLE) AS DOUBLE)
         AS supervisor_district, latitude, longitude, resolution_hours,
       CAST(year(opened) AS INTEGER) AS year, CAST(month(opened) AS INTEGER) AS month,
       CAST(day(opened) AS INTEGER) AS day, CAST(hour(opened) AS INTEGER) AS hour,
       CAST(isodow(opened) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(opened) AS INTEGER) AS week_of_year
FROM (SELECT p.service_request_id, p.supervisor_district, c.opened, c.closed, c.category, c.latitude, c.longitude,
             c.resolution_hours
      FROM portal p JOIN portal_clean c USING (service_request_id))""", "portal", "portal_clean"))
def p02_clean_fetched(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return normalize.clean_fetched(_portal(c)).select(
        "service_request_id", "opened", "closed", "category", "supervisor_district", "latitude", "longitude",
        "resolution_hours", "year", "month", "day", "hour", "day_of_week", "week_of_year")


@query("p16_recent_rows", W("""
SELECT coalesce(service_request_id, 'N/A') AS id, category, coalesce(status_description, 'Unknown') AS status,
       opened, closed, coalesce(address, 'N/A') AS address, district,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
FROM portal_clean ORDER BY opened DESC, service_request_id DESC LIMIT 100""", "portal_clean"))
def p16_recent_rows(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    req = (normalize.normalize_requests(_portal(c)).withColumnRenamed("service_request_id", "case_id")
           .withColumnRenamed("status_description", "status"))
    return normalize.recent_rows(req, 100)


@query("s03_portal_records", W("""
SELECT service_request_id, requested_datetime, closed_date, service_name, status_description, address,
       supervisor_district
FROM portal
WHERE CAST(requested_datetime AS TIMESTAMP) >= TIMESTAMP '2024-01-05'
  AND CAST(requested_datetime AS TIMESTAMP) <= TIMESTAMP '2024-01-12 23:59:59'
ORDER BY CAST(requested_datetime AS TIMESTAMP) DESC, service_request_id DESC LIMIT 500""", "portal"))
def s03_portal_records(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return landing.portal_records(_portal(c), "2024-01-05", "2024-01-12", 500,
                                  tiebreak="service_request_id").drop("point")


@query("p04_raw_date_filter", W("""
SELECT case_id, opened FROM rs
WHERE opened >= TIMESTAMP '2024-01-08' AND opened <= TIMESTAMP '2024-01-21 23:59:59'""", "rs"))
def p04_raw_date_filter(spark, sf_dir):
    return filters.filter_date_range(Ctx(spark, sf_dir).short, "2024-01-08", "2024-01-21").select("case_id", "opened")


@query("p06_month_overlap", W("""
SELECT * FROM (SELECT strftime(opened, '%Y-%m') AS year_month, category, district, count(*) AS count
               FROM rl GROUP BY ALL)
WHERE last_day(CAST(year_month || '-01' AS DATE)) >= DATE '1997-02-15'
  AND CAST(year_month || '-01' AS DATE) <= DATE '1997-05-10'""", "rl"))
def p06_month_overlap(spark, sf_dir):
    return filters.filter_rollup_months(Ctx(spark, sf_dir).monthly_long, "1997-02-15", "1997-05-10")


@query("p09_category_district_filter", W("""
SELECT case_id, opened, category, district FROM rs WHERE category = 'view' AND district = 4""", "rs"))
def p09_category_district_filter(spark, sf_dir):
    df = filters.filter_district(filters.filter_category(Ctx(spark, sf_dir).short, "view"), 4)
    return df.select("case_id", "opened", "category", "district")


@query("p12_valid_resolution", W("""
SELECT case_id, resolution_hours FROM rl
WHERE opened IS NOT NULL AND closed IS NOT NULL AND resolution_hours >= 0 AND resolution_hours < 8760""", "rl"))
def p12_valid_resolution(spark, sf_dir):
    return filters.valid_resolution(Ctx(spark, sf_dir).long).select("case_id", "resolution_hours")


@query("p13_recent_slice", W("""
SELECT case_id, opened, category FROM rl WHERE opened >= (SELECT max(opened) FROM rl) - INTERVAL 90 DAY""", "rl"))
def p13_recent_slice(spark, sf_dir):
    return rollups.recent_raw(Ctx(spark, sf_dir).long, 90).select("case_id", "opened", "category")


@query("p14_grid_snap", W("""
SELECT case_id, CAST(trunc(latitude / 0.01::DOUBLE) AS INTEGER) * 0.01::DOUBLE AS lat_cell,
       CAST(trunc(longitude / 0.01::DOUBLE) AS INTEGER) * 0.01::DOUBLE AS lon_cell,
       CAST(trunc(latitude / 0.01::DOUBLE) AS INTEGER) AS lat_id, CAST(trunc(longitude / 0.01::DOUBLE) AS INTEGER) AS lon_id
FROM rs WHERE latitude BETWEEN 37.5::DOUBLE AND 38.0::DOUBLE AND longitude BETWEEN -123.0::DOUBLE AND -122.0::DOUBLE""",
                          "rs"))
def p14_grid_snap(spark, sf_dir):
    df = Ctx(spark, sf_dir).short.where(in_box("latitude", "longitude", inclusive=True))
    return df.select("case_id", cell_origin("latitude").alias("lat_cell"), cell_origin("longitude").alias("lon_cell"),
                     cell_id("latitude").alias("lat_id"), cell_id("longitude").alias("lon_id"))


@query("s11_rollup_metadata", W("""
SELECT rollup, rows, (SELECT min(CAST(opened AS DATE)) FROM rl) AS start_date,
       (SELECT max(CAST(opened AS DATE)) FROM rl) AS end_date, (SELECT count(*) FROM rl) AS record_count,
       CAST((SELECT max(CAST(opened AS DATE)) FROM rl) - 90 AS DATE) AS recent_cutoff
FROM (SELECT 'daily_agg' AS rollup, count(*) AS rows FROM (SELECT DISTINCT CAST(opened AS DATE), category, district FROM rl)
      UNION ALL SELECT 'monthly_agg', count(*) FROM (SELECT DISTINCT strftime(opened, '%Y-%m'), category, district FROM rl)
      UNION ALL SELECT 'hourly_agg', count(*) FROM (SELECT DISTINCT hour(opened), isodow(opened), category FROM rl)
      UNION ALL SELECT 'grid_agg', count(*) FROM (
          SELECT DISTINCT trunc(latitude / 0.01::DOUBLE), trunc(longitude / 0.01::DOUBLE), category, strftime(opened, '%Y-%m')
          FROM rs WHERE latitude BETWEEN 37.5::DOUBLE AND 38.0::DOUBLE AND longitude BETWEEN -123.0::DOUBLE AND -122.0::DOUBLE)
      UNION ALL SELECT 'resolution_agg', count(*) FROM (
          SELECT DISTINCT category, strftime(opened, '%Y-%m') FROM rl WHERE resolution_hours > 0)
      UNION ALL SELECT 'recent_raw', count(*) FROM rl
          WHERE opened >= (SELECT max(opened) FROM rl) - INTERVAL 90 DAY)""", "rl", "rs"))
def s11_rollup_metadata(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return sinks.rollup_metadata({"daily_agg": c.daily_long, "monthly_agg": c.monthly_long,
                                  "hourly_agg": rollups.hourly_agg(c.long), "grid_agg": rollups.grid_agg(c.short),
                                  "resolution_agg": rollups.resolution_agg(c.long, exact=False),
                                  "recent_raw": rollups.recent_raw(c.long)}, c.daily_long)


@query("s12_validation_report", W("""
SELECT 'events' AS "table", count(*) AS rows, count(*) - count(event_date) AS null_dates, min(event_date) AS min_date,
       max(event_date) AS max_date, count(*) > 0 AS ok FROM ev_src
UNION ALL SELECT 'closures', count(*), count(*) - count(closure_date), min(closure_date), max(closure_date), count(*) > 0
FROM cl_src
UNION ALL SELECT 'permits', count(*), count(*) - count(date), min(date), max(date), count(*) > 0 FROM pm_src
UNION ALL SELECT 'crime', count(*), count(*) - count(date), min(date), max(date), count(*) > 0 FROM crime
UNION ALL SELECT 'weather', count(*), count(*) - count(date), min(date), max(date), count(*) > 0 FROM weather""",
                                  "ev_src", "cl_src", "pm_src", "crime", "weather"))
def s12_validation_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return sinks.validation_report({
        "events": c.events.withColumnRenamed("event_date", "date"),
        "closures": c.closures.withColumnRenamed("closure_date", "date"),
        "permits": c.permits, "crime": c.crime, "weather": c.weather})


@query("s05_weather_arrays", W("SELECT date, temp_max_c, temp_min_c, precip_mm, rain_day FROM weather", "weather"))
def s05_weather_arrays(spark, sf_dir):
    """Weather as the forecast service ships it (one document of parallel daily
    arrays per month), exploded back to rows. Each document holds <= 31 days."""
    w = Ctx(spark, sf_dir).weather
    docs = (w.groupBy(F.date_format("date", "yyyy-MM").alias("ym"))
            .agg(F.array_sort(F.collect_list(F.struct("date", "temp_max_c", "temp_min_c", "precip_mm"))).alias("d"))
            .select(F.struct(F.transform("d", lambda x: F.date_format(x["date"], "yyyy-MM-dd")).alias("time"),
                             F.transform("d", lambda x: x["temp_max_c"]).alias("temperature_2m_max"),
                             F.transform("d", lambda x: x["temp_min_c"]).alias("temperature_2m_min"),
                             F.transform("d", lambda x: x["precip_mm"]).alias("precipitation_sum")).alias("daily")))
    return landing.weather_from_arrays(docs)


@query("s04_side_sources", W("""
SELECT 'events' AS source, event_date AS date, name FROM ev_src
UNION ALL SELECT 'closures', closure_date, name FROM cl_src
UNION ALL SELECT 'permits', date, name FROM pm_src""", "ev_src", "cl_src", "pm_src"))
def s04_side_sources(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return (c.events.select(F.lit("events").alias("source"), F.col("event_date").alias("date"), "name")
            .unionByName(c.closures.select(F.lit("closures").alias("source"), F.col("closure_date").alias("date"),
                                           "name"))
            .unionByName(c.permits.select(F.lit("permits").alias("source"), "date", "name")))


@query("p03_calendar_features", W("""
SELECT case_id, CAST(year(opened) AS INTEGER) AS year, CAST(month(opened) AS INTEGER) AS month,
       CAST(day(opened) AS INTEGER) AS day, CAST(hour(opened) AS INTEGER) AS hour,
       CAST(isodow(opened) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(opened) AS INTEGER) AS week_of_year,
       CAST(quarter(opened) AS INTEGER) AS quarter, CASE WHEN isodow(opened) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM rs""", "rs"))
def p03_calendar_features(spark, sf_dir):
    from ..functions.calendar import calendar_features
    df = calendar_features(Ctx(spark, sf_dir).short.select("case_id", "opened"))
    return df.drop("opened")


@query("p05_rollup_date_filter", W("""
SELECT CAST(opened AS DATE) AS date, category, district, count(*) AS count,
       round(avg(resolution_hours), 2) AS avg_resolution_hours
FROM rl WHERE CAST(opened AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' GROUP BY ALL""", "rl"))
def p05_rollup_date_filter(spark, sf_dir):
    return filters.filter_rollup_dates(Ctx(spark, sf_dir).daily_long, "1997-01-01", "1997-01-31")


@query("p17_load_projection", W("""
SELECT c.opened, c.closed, c.category, TRY_CAST(p.supervisor_district AS DOUBLE) AS supervisor_district,
       c.latitude, c.longitude, c.resolution_hours,
       CAST(year(c.opened) AS INTEGER) AS year, CAST(month(c.opened) AS INTEGER) AS month,
       CAST(day(c.opened) AS INTEGER) AS day, CAST(hour(c.opened) AS INTEGER) AS hour,
       CAST(isodow(c.opened) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(c.opened) AS INTEGER) AS week_of_year,
       p.service_request_id AS case_id
FROM portal p JOIN portal_clean c USING (service_request_id)""", "portal", "portal_clean"))
def p17_load_projection(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    fetched = normalize.clean_fetched(_portal(c).withColumnRenamed("service_request_id", "caseid"))
    return normalize.load_projection(fetched)


@query("a13_top_districts", W("""
SELECT district, count(*) AS count FROM rs WHERE district IS NOT NULL GROUP BY district
ORDER BY count DESC, district LIMIT 10""", "rs"))
def a13_top_districts(spark, sf_dir):
    from ..operators import volume
    return volume.top_k(Ctx(spark, sf_dir).short.where(F.col("district").isNotNull()), "district", 10)


# Every 29th record lands cut off in its middle.
@query("s03_landed_days", W("""
SELECT CAST(CAST(requested_datetime AS TIMESTAMP) AS DATE) AS day, count(*) AS lines,
       count(*) FILTER (CAST(service_request_id AS BIGINT) % 29 = 0) AS unreadable,
       max(CASE WHEN CAST(service_request_id AS BIGINT) % 29 <> 0 THEN requested_datetime END) AS latest,
       count(*) FILTER (CAST(service_request_id AS BIGINT) % 29 <> 0 AND service_name IS NULL) AS unnamed
FROM portal
WHERE CAST(CAST(requested_datetime AS TIMESTAMP) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
GROUP BY ALL""", "portal"))
def s03_landed_days(spark, sf_dir):
    portal = _portal(Ctx(spark, sf_dir))
    path = f"{checkpoint_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*portal.columns))
    cut = F.col("service_request_id").cast("long") % 29 == 0
    (portal.select(F.left("requested_datetime", F.lit(10)).alias("day"),
                   F.when(cut, F.left(line, F.lit(25))).otherwise(line).alias("line"))
     .write.partitionBy("day").text(path))
    days = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))
    return (read_landed(spark, path, portal.schema).where(days).groupBy("day")
            .agg(F.count(F.lit(1)).alias("lines"), F.count("unreadable").alias("unreadable"),
                 F.max(F.when(F.col("unreadable").isNull(), F.col("requested_datetime"))).alias("latest"),
                 F.count_if(F.col("unreadable").isNull() & F.col("service_name").isNull()).alias("unnamed")))

"""Registered queries: rollups and volume/calendar questions."""

from __future__ import annotations

from ..operators import rollups, volume
from .catalog import query
from .context import AS_OF_LONG, LONG_RANGE, SHORT_FIXTURE_RANGE, SHORT_RANGE, Ctx
from .oracle_views import with_views as W

LS, LE = LONG_RANGE
SS, SE = SHORT_RANGE
FS, FE = SHORT_FIXTURE_RANGE

RAW_RANGE_L = f"opened >= TIMESTAMP '{LS} 00:00:00' AND opened <= TIMESTAMP '{LE} 23:59:59'"
RAW_RANGE_S = f"opened >= TIMESTAMP '{SS} 00:00:00' AND opened <= TIMESTAMP '{SE} 23:59:59'"
RAW_RANGE_F = f"opened >= TIMESTAMP '{FS} 00:00:00' AND opened <= TIMESTAMP '{FE} 23:59:59'"
WEEKDAY_DIM = ("(SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), "
               "(4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(day_of_week, day_name))")


# ------------------------------------------------------------------ rollups
@query("a01_daily_agg", W("""
SELECT CAST(opened AS DATE) AS date, category, district, count(*) AS count,
       round(avg(resolution_hours), 2) AS avg_resolution_hours
FROM rl GROUP BY ALL""", "rl"))
def a01_daily_agg(spark, sf_dir):
    return rollups.daily_agg(Ctx(spark, sf_dir).long)


@query("a01_daily_agg_drop_null_district", W("""
SELECT CAST(opened AS DATE) AS date, category, district, count(*) AS count,
       round(avg(resolution_hours), 2) AS avg_resolution_hours
FROM rs WHERE district IS NOT NULL GROUP BY ALL""", "rs"))
def a01_daily_agg_drop_null_district(spark, sf_dir):
    return rollups.daily_agg(Ctx(spark, sf_dir).short, drop_null_keys=True)


@query("a02_monthly_agg", W("""
SELECT strftime(opened, '%Y-%m') AS year_month, category, district, count(*) AS count
FROM rl GROUP BY ALL""", "rl"))
def a02_monthly_agg(spark, sf_dir):
    return rollups.monthly_agg(Ctx(spark, sf_dir).long)


@query("a03_grid_agg", W("""
SELECT lat_id * 0.01::DOUBLE AS lat_cell, lon_id * 0.01::DOUBLE AS lon_cell, category, year_month,
       count(*) AS count, lat_id, lon_id
FROM (SELECT CAST(trunc(latitude / 0.01::DOUBLE) AS INTEGER) AS lat_id,
             CAST(trunc(longitude / 0.01::DOUBLE) AS INTEGER) AS lon_id,
             category, strftime(opened, '%Y-%m') AS year_month
      FROM rs WHERE latitude IS NOT NULL AND longitude IS NOT NULL
        AND latitude BETWEEN 37.5::DOUBLE AND 38.0::DOUBLE AND longitude BETWEEN -123.0::DOUBLE AND -122.0::DOUBLE) g
GROUP BY lat_id, lon_id, category, year_month""", "rs"))
def a03_grid_agg(spark, sf_dir):
    return rollups.grid_agg(Ctx(spark, sf_dir).short)


@query("a04_hourly_agg", W("""
SELECT CAST(hour(opened) AS INTEGER) AS hour, CAST(isodow(opened) - 1 AS INTEGER) AS day_of_week, category, count(*) AS count
FROM rs GROUP BY ALL""", "rs"))
def a04_hourly_agg(spark, sf_dir):
    return rollups.hourly_agg(Ctx(spark, sf_dir).short)


@query("a05_resolution_agg", W("""
SELECT category, strftime(opened, '%Y-%m') AS year_month, round(avg(resolution_hours), 2) AS avg_hours,
       round(median(res_us) / 3.6e9, 2) AS median_hours, count(*) AS count
FROM rs WHERE resolution_hours IS NOT NULL AND resolution_hours > 0 GROUP BY ALL""", "rs"))
def a05_resolution_agg(spark, sf_dir):
    return rollups.resolution_agg(Ctx(spark, sf_dir).short)


@query("a05_resolution_agg_long", W("""
SELECT category, strftime(opened, '%Y-%m') AS year_month, round(avg(resolution_hours), 2) AS avg_hours,
       round(median(res_us) / 3.6e9, 2) AS median_hours, count(*) AS count
FROM rl WHERE resolution_hours IS NOT NULL AND resolution_hours > 0 GROUP BY ALL""", "rl"))
def a05_resolution_agg_long(spark, sf_dir):
    return rollups.resolution_agg(Ctx(spark, sf_dir).long)


@query("a06_recent_by_category", W(f"""
SELECT category, CAST(opened AS DATE) AS date, count(*) AS request_count,
       round(avg(resolution_hours), 2) AS avg_resolution_hours
FROM rl WHERE opened >= TIMESTAMP '{AS_OF_LONG}' - INTERVAL 30 DAY GROUP BY ALL""", "rl"))
def a06_recent_by_category(spark, sf_dir):
    return rollups.recent_by_category(Ctx(spark, sf_dir).long, AS_OF_LONG, 30)


@query("a07_daily_aggregates", W("""
SELECT CAST(opened AS DATE) AS date, category, count(*) AS total_requests,
       round(avg(resolution_hours), 2) AS avg_resolution_hours, count(DISTINCT district) AS neighborhood_count,
       isodow(CAST(opened AS DATE)) >= 6 AS weekend
FROM rl GROUP BY ALL""", "rl"))
def a07_daily_aggregates(spark, sf_dir):
    return rollups.daily_aggregates(Ctx(spark, sf_dir).long)


# ------------------------------------------------------------------ volume
@query("a11_category_counts", W("SELECT category, count(*) AS count FROM rs GROUP BY category", "rs"))
def a11_category_counts(spark, sf_dir):
    return volume.category_counts(Ctx(spark, sf_dir).short)


@query("w11_distinct_categories", W("SELECT DISTINCT category FROM rl", "rl"))
def w11_distinct_categories(spark, sf_dir):
    return volume.distinct_categories(Ctx(spark, sf_dir).long)


@query("w06_top_categories", W("""
SELECT category, count(*) AS count FROM rl GROUP BY category
ORDER BY count DESC, category LIMIT 3""", "rl"))
def w06_top_categories(spark, sf_dir):
    return volume.top_k(Ctx(spark, sf_dir).long, "category", 3)


_STATS_SQL = """
SELECT total_requests, start, "end", n_categories,
       round(total_requests / greatest(days + 1, 1)::DOUBLE, 2) AS daily_average
FROM (SELECT count(*) AS total_requests, min(opened) AS start, max(opened) AS "end",
             count(DISTINCT category) AS n_categories,
             CAST(floor(date_diff('microsecond', min(opened), max(opened)) / 86400000000.0) AS BIGINT) AS days
      FROM {v})"""


@query("a12_dataset_stats", W(_STATS_SQL.format(v="rs"), "rs"))
def a12_dataset_stats(spark, sf_dir):
    return volume.dataset_stats(Ctx(spark, sf_dir).short)


@query("a12_dataset_stats_long", W(_STATS_SQL.format(v="rl"), "rl"))
def a12_dataset_stats_long(spark, sf_dir):
    return volume.dataset_stats(Ctx(spark, sf_dir).long)


@query("a13_fetch_summary", W("""
SELECT count(*) AS total_records, min(opened) AS start, max(opened) AS "end",
       round(avg(resolution_hours), 2) AS avg_resolution_hours,
       CAST(sum(CASE WHEN latitude IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN longitude IS NULL THEN 1 ELSE 0 END)
            AS BIGINT) AS missing_location
FROM rs""", "rs"))
def a13_fetch_summary(spark, sf_dir):
    return volume.fetch_summary(Ctx(spark, sf_dir).short)


_TS_SQL = """
SELECT d.date, d.count, e.event_names, w.precip_mm, w.temp_max_c, w.temp_min_c, w.rain_day
FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS count FROM rl WHERE {rng} GROUP BY 1) d
LEFT JOIN events_by_date e ON d.date = e.date
LEFT JOIN weather w ON d.date = w.date"""


@query("a14_daily_timeseries_rollup", W(_TS_SQL.format(rng=RAW_RANGE_L), "rl", "events_by_date", "weather"))
def a14_daily_timeseries_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.daily_timeseries(c.long, c.daily_long, c.events_by_date, c.weather, LS, LE)


@query("a14_daily_timeseries_raw", W(_TS_SQL.format(rng=RAW_RANGE_S), "rl", "events_by_date", "weather"))
def a14_daily_timeseries_raw(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.daily_timeseries(c.long, c.daily_long, c.events_by_date, c.weather, SS, SE)


_DOW_SQL = """
SELECT dim.day_of_week, dim.day_name, coalesce(d.count, 0) AS count,
       coalesce(round(CAST(coalesce(d.count, 0) AS DOUBLE) / sum(coalesce(d.count, 0)) OVER () * 100.0, 1), 0.0)
         AS percentage
FROM {dim} dim LEFT JOIN (SELECT CAST(isodow(opened) - 1 AS INTEGER) AS day_of_week, count(*) AS count FROM {v} WHERE {rng} GROUP BY 1) d
  ON dim.day_of_week = d.day_of_week"""


@query("a15_day_of_week_rollup", W(_DOW_SQL.format(dim=WEEKDAY_DIM, v="rl", rng=RAW_RANGE_L), "rl"))
def a15_day_of_week_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.day_of_week_profile(c.long, c.daily_long, LS, LE)


@query("a15_day_of_week_raw", W(_DOW_SQL.format(dim=WEEKDAY_DIM, v="rs", rng=RAW_RANGE_F), "rs"))
def a15_day_of_week_raw(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.day_of_week_profile(c.short, None, FS, FE)


@query("a16_hourly_profile", W(f"""
SELECT hour, count, row_number() OVER (ORDER BY count DESC, hour) = 1 AS is_peak
FROM (SELECT CAST(hour(opened) AS INTEGER) AS hour, count(*) AS count FROM rs WHERE {RAW_RANGE_F} GROUP BY 1)""", "rs"))
def a16_hourly_profile(spark, sf_dir):
    return volume.hourly_profile(Ctx(spark, sf_dir).short, FS, FE)


@query("a16_hourly_profile_rollup", W("""
SELECT hour, count, row_number() OVER (ORDER BY count DESC, hour) = 1 AS is_peak
FROM (SELECT CAST(hour(opened) AS INTEGER) AS hour, count(*) AS count FROM rs GROUP BY 1)""", "rs"))
def a16_hourly_profile_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.hourly_profile(c.short, hourly_rollup=rollups.hourly_agg(c.short))


@query("a30_peak_window_share", W("""
SELECT hour, count, round(CAST(count AS DOUBLE) / sum(count) OVER () * 100.0, 1) AS share,
       round(CAST(sum(CASE WHEN hour BETWEEN 8 AND 11 THEN count ELSE 0 END) OVER () AS DOUBLE)
             / sum(count) OVER () * 100.0, 1) AS window_share
FROM (SELECT CAST(hour(opened) AS INTEGER) AS hour, count(*) AS count FROM rs GROUP BY 1)""", "rs"))
def a30_peak_window_share(spark, sf_dir):
    return volume.peak_window_share(Ctx(spark, sf_dir).short, 8, 11)


_MONTHLY_SQL = """
SELECT year_month, count, round(avg(count) OVER (), 0) AS average
FROM (SELECT strftime(opened, '%Y-%m') AS year_month, count(*) AS count FROM rl WHERE {rng} GROUP BY 1)"""


@query("a17_monthly_trend_rollup", W(_MONTHLY_SQL.format(
    rng=f"opened >= TIMESTAMP '{LS[:8]}01' AND opened < date_trunc('month', TIMESTAMP '{LE}') + INTERVAL 1 MONTH"),
    "rl"))
def a17_monthly_trend_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.monthly_trend(c.long, c.monthly_long, LS, LE)


@query("a17_monthly_trend_rollup_unaligned", W(_MONTHLY_SQL.format(
    rng="opened >= TIMESTAMP '1996-02-01' AND opened < TIMESTAMP '1998-12-01'"), "rl"))
def a17_monthly_trend_rollup_unaligned(spark, sf_dir):
    """A long range inside months is answered by the whole months that it touches."""
    c = Ctx(spark, sf_dir)
    return volume.monthly_trend(c.long, c.monthly_long, "1996-02-15", "1998-11-10")


@query("a17_monthly_trend_raw", W(_MONTHLY_SQL.format(rng=RAW_RANGE_S), "rl"))
def a17_monthly_trend_raw(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.monthly_trend(c.long, c.monthly_long, SS, SE)


@query("a33_month_growth", W("""
SELECT year_month, count,
       round(CAST(count - first_value(count) OVER (ORDER BY year_month) AS DOUBLE)
             / first_value(count) OVER (ORDER BY year_month) * 100.0, 1) AS growth_pct
FROM (SELECT strftime(opened, '%Y-%m') AS year_month, count(*) AS count FROM rl GROUP BY 1)""", "rl"))
def a33_month_growth(spark, sf_dir):
    return volume.month_growth(Ctx(spark, sf_dir).long)


@query("a22_category_timeseries", W("""
SELECT date, count, count(*) OVER () AS total_days, CAST(sum(count) OVER () AS BIGINT) AS total_count
FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS count FROM rs WHERE category = 'error' GROUP BY 1)""", "rs"))
def a22_category_timeseries(spark, sf_dir):
    return volume.category_timeseries(Ctx(spark, sf_dir).short, "error")


@query("a23_compare_periods", W("""
SELECT base_total, compare_total,
       CASE WHEN compare_total > 0 THEN round(CAST(base_total - compare_total AS DOUBLE) / compare_total * 100.0, 1)
       END AS change_percent
FROM (SELECT count(*) FILTER (WHERE opened >= TIMESTAMP '1997-01-01' AND opened <= TIMESTAMP '1997-12-31 23:59:59')
               AS base_total,
             count(*) FILTER (WHERE opened >= TIMESTAMP '1996-01-01' AND opened <= TIMESTAMP '1996-03-31 23:59:59')
               AS compare_total
      FROM rl WHERE category = '1-URGENT')""", "rl"))
def a23_compare_periods(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.compare_periods(c.long, c.daily_long, "1997-01-01", "1997-12-31", "1996-01-01", "1996-03-31",
                                  "1-URGENT")


_PERIODS_SQL = """
SELECT base_total, compare_total,
       CASE WHEN compare_total > 0 THEN round(CAST(base_total - compare_total AS DOUBLE) / compare_total * 100.0, 1)
       END AS change_percent
FROM (SELECT count(*) FILTER (WHERE opened >= TIMESTAMP '{a}' AND opened <= TIMESTAMP '{b} 23:59:59') AS base_total,
             count(*) FILTER (WHERE opened >= TIMESTAMP '{c}' AND opened <= TIMESTAMP '{d} 23:59:59') AS compare_total
      FROM rl)"""


@query("a23_compare_periods_raw", W(_PERIODS_SQL.format(a="1997-03-03", b="1997-03-09", c="1997-03-10", d="1997-03-16"), "rl"))
def a23_compare_periods_raw(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.compare_periods(c.long, c.daily_long, "1997-03-03", "1997-03-09", "1997-03-10", "1997-03-16")


@query("a23_compare_periods_rollup", W(_PERIODS_SQL.format(a="1997-01-01", b="1997-12-31", c="1996-01-01", d="1996-12-31"), "rl"))
def a23_compare_periods_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.compare_periods(c.long, c.daily_long, "1997-01-01", "1997-12-31", "1996-01-01", "1996-12-31")


@query("a12_top_categories", W("SELECT category, count(*) AS count FROM rl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "rl"))
def a12_top_categories(spark, sf_dir):
    return volume.top_k(Ctx(spark, sf_dir).long, "category", 10)


@query("a24_freshness", W("""
SELECT '311' AS dataset, max(CAST(opened AS DATE)) AS last_date FROM rl
UNION ALL SELECT 'events', max(date) FROM events_agg
UNION ALL SELECT 'crime', max(date) FROM crime_agg
UNION ALL SELECT 'weather', max(date) FROM weather""", "rl", "events_agg", "crime_agg", "weather"))
def a24_freshness(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return volume.freshness({"311": c.daily_long, "events": c.events_agg, "crime": c.crime_agg,
                             "weather": c.weather})


@query("a31_weekday_weekend", W("""
SELECT category, weekday_n, weekend_n,
       round(CAST(weekday_n AS DOUBLE) / nullif(weekend_n, 0), 2) AS ratio
FROM (SELECT category, CAST(sum(CASE WHEN isodow(opened) < 6 THEN 1 ELSE 0 END) AS BIGINT) AS weekday_n,
             CAST(sum(CASE WHEN isodow(opened) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS weekend_n
      FROM rl GROUP BY ROLLUP (category))""", "rl"))
def a31_weekday_weekend(spark, sf_dir):
    return volume.weekday_weekend(Ctx(spark, sf_dir).long)


@query("a32_category_peak_hours", W("""
SELECT category, hour AS peak_hour, n AS peak_count, evening_share FROM (
  SELECT category, hour, n,
         row_number() OVER (PARTITION BY category ORDER BY n DESC, hour) AS rn,
         round(CAST(sum(CASE WHEN hour >= 18 THEN n ELSE 0 END) OVER (PARTITION BY category) AS DOUBLE)
               / sum(n) OVER (PARTITION BY category) * 100.0, 1) AS evening_share
  FROM (SELECT category, CAST(hour(opened) AS INTEGER) AS hour, count(*) AS n FROM rs GROUP BY ALL)) WHERE rn = 1""", "rs"))
def a32_category_peak_hours(spark, sf_dir):
    return volume.category_peak_hours(Ctx(spark, sf_dir).short)


@query("a39_weekday_baseline", W("""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round(avg(count), 1) AS avg_daily, count(*) AS n_days
FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS count FROM rl GROUP BY 1) GROUP BY 1""", "rl"))
def a39_weekday_baseline(spark, sf_dir):
    return volume.weekday_baseline(Ctx(spark, sf_dir).long)


@query("a40_week_over_week", W("""
SELECT category, week, count,
       round(CAST(count - lag(count) OVER (PARTITION BY category ORDER BY week) AS DOUBLE)
             / lag(count) OVER (PARTITION BY category ORDER BY week) * 100.0, 1) AS wow_pct
FROM (SELECT category, CAST(date_trunc('week', opened) AS DATE) AS week, count(*) AS count FROM rl GROUP BY ALL)""",
     "rl"))
def a40_week_over_week(spark, sf_dir):
    return volume.week_over_week(Ctx(spark, sf_dir).long)

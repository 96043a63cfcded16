"""Registered queries: side tables, joins, correlations, resolution, district, geo, anomaly, insights."""

from __future__ import annotations

from ..constants import CATEGORY_COLORS
from ..operators import (anomaly, correlation, district, events, geo, insights, resolution, rollups, weather)
from ..operators import filters
from ..sources import landing
from .catalog import ORACLE, query
from .context import SHORT_FIXTURE_RANGE, Ctx
from .oracle_views import with_views as W

FS, FE = SHORT_FIXTURE_RANGE
RAW_RANGE_F = f"opened >= TIMESTAMP '{FS} 00:00:00' AND opened <= TIMESTAMP '{FE} 23:59:59'"
VALID = "opened IS NOT NULL AND closed IS NOT NULL AND resolution_hours >= 0 AND resolution_hours < 8760"
COLORS_SQL = "[" + ", ".join(f"'{c}'" for c in CATEGORY_COLORS) + "]"
EVENT_DAY = "(coalesce(event_count, 0) + coalesce(street_closure_count, 0) + coalesce(construction_count, 0)) > 0"


# ------------------------------------------------------------------ side tables
@query("a08_events_agg", W("SELECT * FROM events_agg", "events_agg"))
def a08_events_agg(spark, sf_dir):
    return Ctx(spark, sf_dir).events_agg


@query("a09_events_by_date", W("SELECT * FROM events_by_date", "events_by_date"))
def a09_events_by_date(spark, sf_dir):
    return Ctx(spark, sf_dir).events_by_date


@query("a10_crime_agg", W("SELECT * FROM crime_agg", "crime_agg"))
def a10_crime_agg(spark, sf_dir):
    return Ctx(spark, sf_dir).crime_agg


@query("p18_events_lookup", W("""
SELECT date, event_names FROM events_by_date WHERE date >= DATE '1997-01-01' AND date <= DATE '1997-06-30'""",
                              "events_by_date"))
def p18_events_lookup(spark, sf_dir):
    ebd = Ctx(spark, sf_dir).events_by_date
    return filters.filter_rollup_dates(ebd, "1997-01-01", "1997-06-30").orderBy("date")


@query("p19_weather_lookup", W("""
SELECT date, precip_mm, temp_max_c, temp_min_c, rain_day FROM weather
WHERE date >= DATE '1998-02-01' AND date <= DATE '1998-05-15'""", "weather"))
def p19_weather_lookup(spark, sf_dir):
    return weather.weather_lookup(Ctx(spark, sf_dir).weather, "1998-02-01", "1998-05-15")


@query("s13_unified_events", W("""
SELECT event_date AS date, 'event' AS event_type, name, CAST(NULL AS INTEGER) AS district, 'events' AS source_dataset
FROM ev_src
UNION ALL SELECT closure_date, 'street_closure', name, NULL, 'closures' FROM cl_src
UNION ALL SELECT date, event_type, name, NULL, 'permits' FROM pm_src
UNION ALL SELECT date, 'crime', NULL, district, 'crime' FROM crime""", "ev_src", "cl_src", "pm_src", "crime"))
def s13_unified_events(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return landing.unified_events(c.events, c.closures, c.permits, c.crime).select(
        "date", "event_type", "name", "district", "source_dataset")


# ------------------------------------------------------------------ weather / joins
@query("a18_weather_impact", W("""
SELECT category, round(rainy, 0) AS rainy_day_avg, round(dry, 0) AS dry_day_avg,
       round(CAST(rainy - dry AS DOUBLE) / dry * 100.0, 1) AS impact_percent
FROM s WHERE dry > 0 AND (category IS NULL OR rainy IS NOT NULL)""", "rl", "weather", extra="""
d AS (SELECT category, CAST(opened AS DATE) AS date, w.rain_day = 1 AS is_rainy
      FROM rl JOIN weather w ON CAST(opened AS DATE) = w.date),
per_day AS (SELECT category, date, is_rainy, count(*) AS n FROM d GROUP BY ALL),
overall_day AS (SELECT date, is_rainy, sum(n) AS n FROM per_day GROUP BY ALL),
top AS (SELECT category FROM d GROUP BY category ORDER BY count(*) DESC, category LIMIT 10),
s AS (SELECT CAST(NULL AS VARCHAR) AS category, avg(n) FILTER (WHERE is_rainy) AS rainy,
             avg(n) FILTER (WHERE NOT is_rainy) AS dry FROM overall_day
      UNION ALL
      SELECT category, avg(n) FILTER (WHERE is_rainy), avg(n) FILTER (WHERE NOT is_rainy)
      FROM per_day WHERE category IN (SELECT category FROM top) GROUP BY category)"""))
def a18_weather_impact(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return weather.weather_impact(c.long, c.weather)


@query("a25_crime_correlation", W("""
SELECT CASE WHEN count(*) >= 2 THEN round(corr(CAST(total_requests AS DOUBLE), CAST(incident_count AS DOUBLE)), 4)
       END AS correlation,
       count(*) AS days_matched, round(avg(total_requests), 1) AS avg_311, round(avg(incident_count), 1) AS avg_incidents
FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS total_requests FROM rl GROUP BY 1) d
JOIN (SELECT date, CAST(sum(count) AS BIGINT) AS incident_count FROM crime_agg GROUP BY 1) c USING (date)""",
                                  "rl", "crime_agg"))
def a25_crime_correlation(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return correlation.correlation(c.long, events.crime_daily(c.crime_agg), "incident_count")


@query("j09_correlation_by_district", W("""
SELECT district,
       CASE WHEN count(*) >= 2 THEN round(corr(CAST(total_requests AS DOUBLE), CAST(incident_count AS DOUBLE)), 4)
       END AS correlation,
       count(*) AS days_matched, round(avg(total_requests), 1) AS avg_311, round(avg(incident_count), 1) AS avg_incidents
FROM (SELECT CAST(opened AS DATE) AS date, district, count(*) AS total_requests FROM rl GROUP BY ALL) d
JOIN (SELECT date, district, count AS incident_count FROM crime_agg) c USING (date, district)
GROUP BY district""", "rl", "crime_agg"))
def j09_correlation_by_district(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    crime_by_district = c.crime_agg.withColumnRenamed("count", "incident_count")
    return correlation.correlation(c.long, crime_by_district, "incident_count", keys=["district"])


@query("a26_event_lift", W(f"""
SELECT round(ev, 1) AS event_days_avg_requests, round(ne, 1) AS non_event_days_avg_requests,
       round(CAST(ev - ne AS DOUBLE) / ne * 100.0, 1) AS lift_percent, event_days_count, non_event_days_count
FROM (SELECT avg(total_requests) FILTER (WHERE has_events) AS ev,
             avg(total_requests) FILTER (WHERE NOT has_events) AS ne,
             count(*) FILTER (WHERE has_events) AS event_days_count,
             count(*) FILTER (WHERE NOT has_events) AS non_event_days_count
      FROM (SELECT d.total_requests, coalesce({EVENT_DAY}, false) AS has_events
            FROM (SELECT CAST(opened AS DATE) AS date, count(*) AS total_requests FROM rl GROUP BY 1) d
            LEFT JOIN events_agg e ON d.date = e.date))""", "rl", "events_agg"))
def a26_event_lift(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return correlation.event_lift(c.long, c.events_agg)


@query("a27_top_categories_event_days", W(f"""
SELECT category, count(*) AS count FROM rl
WHERE CAST(opened AS DATE) IN (SELECT date FROM events_agg WHERE {EVENT_DAY})
GROUP BY category ORDER BY count DESC, category LIMIT 10""", "rl", "events_agg"))
def a27_top_categories_event_days(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return correlation.top_categories_on_event_days(c.long, c.events_agg)


@query("j08_densify", W("""
SELECT k.category, CAST(g.date AS DATE) AS date, coalesce(d.count, 0) AS count
FROM (SELECT DISTINCT category FROM rl) k
CROSS JOIN generate_series(DATE '1997-01-01', DATE '1997-03-31', INTERVAL 1 DAY) g(date)
LEFT JOIN (SELECT category, CAST(opened AS DATE) AS date, count(*) AS count FROM rl GROUP BY ALL) d
  ON d.category = k.category AND d.date = CAST(g.date AS DATE)""", "rl"))
def j08_densify(spark, sf_dir):
    import datetime as dt
    from pyspark.sql import functions as F
    c = Ctx(spark, sf_dir)
    daily = c.long.groupBy("category", F.to_date("opened").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    cats = c.long.select("category").distinct()
    return anomaly.densify(daily, cats, "category", dt.date(1997, 1, 1), dt.date(1997, 3, 31))


# ------------------------------------------------------------------ resolution
@query("a20_resolution_by_category", W(f"""
SELECT category, round(avg(resolution_hours), 2) AS avg_hours, round(median(res_us) / 3.6e9, 2) AS median_hours,
       count(*) AS sample_size
FROM rs WHERE {VALID} GROUP BY category HAVING count(*) >= 10""", "rs"))
def a20_resolution_by_category(spark, sf_dir):
    return resolution.resolution_by_category(Ctx(spark, sf_dir).short, 10)


@query("a20_resolution_overall", W(f"""
SELECT round(avg(resolution_hours), 2) AS overall_avg_hours, round(median(res_us) / 3.6e9, 2) AS overall_median_hours,
       count(*) AS sample_size
FROM rs WHERE {VALID}""", "rs"))
def a20_resolution_overall(spark, sf_dir):
    return resolution.resolution_overall(Ctx(spark, sf_dir).short)


@query("a20_resolution_by_category_long", W(f"""
SELECT category, round(avg(resolution_hours), 2) AS avg_hours, round(median(res_us) / 3.6e9, 2) AS median_hours,
       count(*) AS sample_size
FROM rl WHERE {VALID} GROUP BY category HAVING count(*) >= 10""", "rl"))
def a20_resolution_by_category_long(spark, sf_dir):
    return resolution.resolution_by_category(Ctx(spark, sf_dir).long, 10)


@query("a21_resolution_by_hour", W(f"""
SELECT CAST(hour(opened) AS INTEGER) AS hour, round(avg(resolution_hours), 2) AS avg_hours, count(*) AS count
FROM rs WHERE {VALID} GROUP BY 1 HAVING count(*) >= 5""", "rs"))
def a21_resolution_by_hour(spark, sf_dir):
    return resolution.resolution_by_hour(Ctx(spark, sf_dir).short, 5)


@query("a36_mean_vs_median", W(f"""
SELECT category, round(avg(resolution_hours), 2) AS avg_hours, round(median(res_us) / 3.6e9, 2) AS median_hours,
       round(avg(resolution_hours) / (median(res_us) / 3.6e9), 2) AS skew_ratio
FROM rs WHERE {VALID} GROUP BY category""", "rs"))
def a36_mean_vs_median(spark, sf_dir):
    return resolution.mean_vs_median(Ctx(spark, sf_dir).short)


@query("a41_sla_breach", W(f"""
SELECT category, count(*) AS n, CAST(sum(CASE WHEN resolution_hours > 72.0 THEN 1 ELSE 0 END) AS BIGINT) AS breached,
       round(CAST(sum(CASE WHEN resolution_hours > 72.0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100.0, 1)
         AS breach_share
FROM rs WHERE {VALID} GROUP BY category""", "rs"))
def a41_sla_breach(spark, sf_dir):
    return resolution.sla_breach(Ctx(spark, sf_dir).short, 72.0)


# ------------------------------------------------------------------ district
_BREAKDOWN_SQL = """
SELECT c.district, coalesce(d.name, 'District ' || c.district) AS name, c.count,
       round(CAST(c.count AS DOUBLE) / sum(c.count) OVER () * 100.0, 2) AS percentage
FROM (SELECT district, count(*) AS count FROM {v} WHERE district IS NOT NULL GROUP BY 1) c
LEFT JOIN districts d ON c.district = d.district"""


@query("a19_district_breakdown", W(_BREAKDOWN_SQL.format(v="rs"), "rs", "districts"))
def a19_district_breakdown(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return district.district_breakdown(c.short, c.districts)


@query("a19_district_breakdown_long", W(_BREAKDOWN_SQL.format(v="rl"), "rl", "districts"))
def a19_district_breakdown_long(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return district.district_breakdown(c.long, c.districts)


@query("a35_district_concentration", W("""
SELECT category, district, count, concentration FROM (
  SELECT category, district, count,
         round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY category) * 100.0, 1) AS concentration,
         row_number() OVER (PARTITION BY category ORDER BY count DESC, district) AS rn
  FROM (SELECT category, district, count(*) AS count FROM rs WHERE district IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
                                       "rs"))
def a35_district_concentration(spark, sf_dir):
    return district.district_concentration(Ctx(spark, sf_dir).short)


@query("a37_district_cumulative_share", W("""
SELECT district, count, row_number() OVER (ORDER BY count DESC, district) AS rank,
       round(CAST(sum(count) OVER (ORDER BY count DESC, district ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS DOUBLE) / sum(count) OVER () * 100.0, 2) AS cum_share
FROM (SELECT district, count(*) AS count FROM rl WHERE district IS NOT NULL GROUP BY 1)""", "rl"))
def a37_district_cumulative_share(spark, sf_dir):
    return district.district_cumulative_share(Ctx(spark, sf_dir).long)


@query("a38_district_risk", W(f"""
SELECT district, count, round(avg_h, 2) AS avg_hours,
       round(percent_rank() OVER (ORDER BY count) + percent_rank() OVER (ORDER BY avg_h), 4) AS score
FROM (SELECT district, count(*) AS count FROM rs WHERE district IS NOT NULL GROUP BY 1) v
JOIN (SELECT district, avg(resolution_hours) AS avg_h FROM rs WHERE district IS NOT NULL AND {VALID} GROUP BY 1) s
USING (district)""", "rs"))
def a38_district_risk(spark, sf_dir):
    return district.district_risk(Ctx(spark, sf_dir).short)


# ------------------------------------------------------------------ geo
_POINTS = f"""
f AS (SELECT * FROM rs WHERE {RAW_RANGE_F} AND latitude IS NOT NULL AND longitude IS NOT NULL
        AND latitude > 37.5::DOUBLE AND latitude < 38.0::DOUBLE
        AND longitude > -123.0::DOUBLE AND longitude < -122.0::DOUBLE),
top AS (SELECT category, row_number() OVER (ORDER BY n DESC, category) AS rank
        FROM (SELECT category, count(*) AS n FROM f GROUP BY 1) ORDER BY n DESC, category LIMIT 10)"""


@query("a28_map_points", W(f"""
SELECT f.category, top.rank, {COLORS_SQL}[top.rank] AS color, latitude AS lat, longitude AS lon
FROM f JOIN top USING (category)""", "rs", extra=_POINTS))
def a28_map_points(spark, sf_dir):
    return geo.map_points(Ctx(spark, sf_dir).short, FS, FE)


@query("a28_map_category_totals", W(f"""
SELECT f.category, top.rank, {COLORS_SQL}[top.rank] AS color, count(*) AS count
FROM f JOIN top USING (category) GROUP BY ALL""", "rs", extra=_POINTS))
def a28_map_category_totals(spark, sf_dir):
    return geo.map_category_totals(Ctx(spark, sf_dir).short, FS, FE)


_GRID = """
g AS (SELECT lat_id * 0.01::DOUBLE AS lat_cell, lon_id * 0.01::DOUBLE AS lon_cell, category, year_month,
             count(*) AS count, lat_id, lon_id
      FROM (SELECT CAST(trunc(latitude / 0.01::DOUBLE) AS INTEGER) AS lat_id,
                   CAST(trunc(longitude / 0.01::DOUBLE) AS INTEGER) AS lon_id,
                   category, strftime(opened, '%Y-%m') AS year_month
            FROM rs WHERE latitude IS NOT NULL AND longitude IS NOT NULL
              AND latitude BETWEEN 37.5::DOUBLE AND 38.0::DOUBLE
              AND longitude BETWEEN -123.0::DOUBLE AND -122.0::DOUBLE) x
      GROUP BY lat_id, lon_id, category, year_month)"""


@query("a29_map_heatmap", W(f"""
SELECT gf.category, top.rank, {COLORS_SQL}[top.rank] AS color, lat_cell, lon_cell, year_month, count,
       CAST(sum(count) OVER (PARTITION BY gf.category) AS BIGINT) AS category_count,
       (SELECT CAST(sum(count) AS BIGINT) FROM gf) AS total_points
FROM gf JOIN top USING (category)""", "rs", extra=_GRID + """,
gf AS (SELECT * FROM g WHERE last_day(CAST(year_month || '-01' AS DATE)) >= DATE '2024-01-01'
         AND CAST(year_month || '-01' AS DATE) <= DATE '2024-01-31'),
top AS (SELECT category, row_number() OVER (ORDER BY n DESC, category) AS rank
        FROM (SELECT category, count(*) AS n FROM gf GROUP BY 1) ORDER BY n DESC, category LIMIT 3)"""))
def a29_map_heatmap(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return geo.map_heatmap(rollups.grid_agg(c.short), "2024-01-01", "2024-01-31", None, 3)


@query("m07_hotspots", W("""
SELECT row_number() OVER (ORDER BY volume DESC, lat_id, lon_id) AS rank, lat_cell, lon_cell,
       volume AS predicted_volume, top_categories
FROM cells JOIN tc USING (lat_id, lon_id)""", "rs", extra=_GRID + """,
bc AS (SELECT lat_id, lon_id, lat_cell, lon_cell, category, sum(count) AS n FROM g GROUP BY ALL),
cells AS (SELECT lat_id, lon_id, lat_cell, lon_cell, CAST(sum(n) AS BIGINT) AS volume FROM bc GROUP BY ALL
          ORDER BY volume DESC, lat_id, lon_id LIMIT 10),
tc AS (SELECT lat_id, lon_id, string_agg(category, '|' ORDER BY rn) AS top_categories
       FROM (SELECT *, row_number() OVER (PARTITION BY lat_id, lon_id ORDER BY n DESC, category) AS rn FROM bc)
       WHERE rn <= 3 GROUP BY ALL)"""))
def m07_hotspots(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return geo.hotspots(rollups.grid_agg(c.short), None, None, 10, 3)


# ------------------------------------------------------------------ anomaly / insights
@query("w04_anomalies", W("""
SELECT fl.date, category, CAST(count AS BIGINT) AS actual_count, round(a, 1) AS expected_count,
       round(dev, 2) AS deviation_factor,
       CASE WHEN len(nm) > 0 THEN 'Same-day events: ' || array_to_string(list_transform(nm[1:3], lambda x: trim(x)), ', ')
            || CASE WHEN len(nm) > 3 THEN '...' ELSE '' END END AS possible_event_cause
FROM fl LEFT JOIN (SELECT date, list_filter(string_split(event_names, '|'), lambda x: trim(x) <> '') AS nm
                   FROM events_by_date) e ON fl.date = e.date
WHERE dev > 2.0""", "rs", "events_by_date", extra="""
base AS (SELECT category, CAST(opened AS DATE) AS date FROM rs WHERE opened IS NOT NULL),
mx AS (SELECT max(date) AS max_date FROM base),
top AS (SELECT category FROM base GROUP BY category ORDER BY count(*) DESC, category LIMIT 20),
daily AS (SELECT date, category, count(*) AS count FROM base, mx
          WHERE date >= max_date - 36 AND category IN (SELECT category FROM top) GROUP BY ALL),
grid AS (SELECT t.category,
                CAST(unnest(generate_series(CAST(max_date - 36 AS TIMESTAMP), CAST(max_date AS TIMESTAMP),
                                            INTERVAL 1 DAY)) AS DATE) AS date
         FROM top t, mx),
dense AS (SELECT g.category, g.date, coalesce(d.count, 0) AS count FROM grid g LEFT JOIN daily d USING (category, date)),
st AS (SELECT category, date, count, sum(count) OVER w AS s, sum(count * count) OVER w AS q, count(*) OVER w AS n
       FROM dense WINDOW w AS (PARTITION BY category ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
fl AS (SELECT st.*, s / n AS a, (n * count - s) / sqrt(CAST(n * q - s * s AS DOUBLE)) AS dev
       FROM st, mx WHERE date >= max_date - 6 AND n >= 7 AND n * q - s * s <> 0)"""))
def w04_anomalies(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return anomaly.anomalies(c.short, c.events_by_date)


@query("w04_anomalies_low_bar", ORACLE["w04_anomalies"].replace("WHERE dev > 2.0", "WHERE dev > 1.0"))
def w04_anomalies_low_bar(spark, sf_dir):
    """A bar that the short table's even days reach, too."""
    c = Ctx(spark, sf_dir)
    return anomaly.anomalies(c.short, c.events_by_date, z=1.0)


@query("w04_anomalies_long", W("""
SELECT fl.date, category, CAST(count AS BIGINT) AS actual_count, round(a, 1) AS expected_count,
       round(dev, 2) AS deviation_factor,
       CASE WHEN len(nm) > 0 THEN 'Same-day events: ' || array_to_string(list_transform(nm[1:3], lambda x: trim(x)), ', ')
            || CASE WHEN len(nm) > 3 THEN '...' ELSE '' END END AS possible_event_cause
FROM fl LEFT JOIN (SELECT date, list_filter(string_split(event_names, '|'), lambda x: trim(x) <> '') AS nm
                   FROM events_by_date) e ON fl.date = e.date
WHERE dev > 2.0""", "rl", "events_by_date", extra="""
base AS (SELECT category, CAST(opened AS DATE) AS date FROM rl WHERE opened IS NOT NULL),
mx AS (SELECT max(date) AS max_date FROM base),
top AS (SELECT category FROM base GROUP BY category ORDER BY count(*) DESC, category LIMIT 20),
daily AS (SELECT date, category, count(*) AS count FROM base, mx
          WHERE date >= max_date - 36 AND category IN (SELECT category FROM top) GROUP BY ALL),
grid AS (SELECT t.category,
                CAST(unnest(generate_series(CAST(max_date - 36 AS TIMESTAMP), CAST(max_date AS TIMESTAMP),
                                            INTERVAL 1 DAY)) AS DATE) AS date
         FROM top t, mx),
dense AS (SELECT g.category, g.date, coalesce(d.count, 0) AS count FROM grid g LEFT JOIN daily d USING (category, date)),
st AS (SELECT category, date, count, sum(count) OVER w AS s, sum(count * count) OVER w AS q, count(*) OVER w AS n
       FROM dense WINDOW w AS (PARTITION BY category ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
fl AS (SELECT st.*, s / n AS a, (n * count - s) / sqrt(CAST(n * q - s * s AS DOUBLE)) AS dev
       FROM st, mx WHERE date >= max_date - 6 AND n >= 7 AND n * q - s * s <> 0)"""))
def w04_anomalies_long(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return anomaly.anomalies(c.long, c.events_by_date)


@query("a34_category_growth", W("""
SELECT category, first_half, second_half,
       round(CAST(second_half - first_half AS DOUBLE) / first_half * 100.0, 1) AS growth_pct,
       CASE WHEN round(CAST(second_half - first_half AS DOUBLE) / first_half * 100.0, 1) > 5.0 THEN 'GROWING'
            WHEN round(CAST(second_half - first_half AS DOUBLE) / first_half * 100.0, 1) < -5.0 THEN 'DECLINING'
            ELSE 'STABLE' END AS trend
FROM (SELECT category,
             CAST(sum(CASE WHEN epoch_us(opened) < mid THEN 1 ELSE 0 END) AS BIGINT) AS first_half,
             CAST(sum(CASE WHEN epoch_us(opened) >= mid THEN 1 ELSE 0 END) AS BIGINT) AS second_half
      FROM rl, (SELECT CAST(trunc((epoch_us(min(opened)) + epoch_us(max(opened))) / 2) AS BIGINT) AS mid FROM rl) m
      GROUP BY category)""", "rl"))
def a34_category_growth(spark, sf_dir):
    return insights.category_growth(Ctx(spark, sf_dir).long)

"""Registered queries: yearly season, rolling origins, ranges cut into months, days and edges, rollups of one
scan, quantile and distinct-count sketches, numbered copies, neighbourhoods and reports from writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import forecast, geo, normalize, rollups, seasonal
from ..sources import sinks
from ..session import materialize, tasks_for
from ..sources.tables import read_table
from ..streaming import jobs
from . import ranges
from .catalog import ORACLE, query
from .context import Ctx
from .oracle_views import with_views as W
from .q_io import _folder as folder
from .q_model import _FEAT, _VOL, FC_START
from .q_more import s11_rollup_metadata  # noqa: F401  (its SQL is used here)
from .q_side import _GRID

SIZE = 8 + 2 * seasonal.TERMS


def _design(date: str) -> str:
    """The regression's columns of a day as a list."""
    years = f"(date_diff('day', DATE '2000-01-01', {date}) / 365.25::DOUBLE)"
    waves = [f"{f}({years} * (2 * pi() * {k}))" for k in range(1, seasonal.TERMS + 1) for f in ("sin", "cos")]
    return "[" + ", ".join(["1.0::DOUBLE", years, *[f"(isodow({date}) = {k + 1})::DOUBLE" for k in range(6)], *waves]) + "]"


def _ridge(rows: str) -> str:
    """Normal equations of ``rows(category, date, volume)`` and their solution by elimination: ``beta(category, beta)``."""
    last = SIZE + 1
    sql = [f"""ft AS MATERIALIZED (SELECT category, CAST(volume AS DOUBLE) AS y, {_design('date')} AS x FROM {rows}),
g0 AS MATERIALIZED (
  SELECT category, i, j, sum(x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN {seasonal.RIDGE}::DOUBLE ELSE 0 END AS v
  FROM ft, range(1, {last}) a(i), range(1, {last}) b(j) GROUP BY category, i, j
  UNION ALL SELECT category, i, {last}, sum(x[i] * y) FROM ft, range(1, {last}) a(i) GROUP BY ALL)"""]
    for k in range(1, last):
        sql.append(f"""g{k} AS MATERIALIZED (
  SELECT a.category, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - f.v / p.v * r.v END AS v
  FROM g{k - 1} a JOIN g{k - 1} p ON p.category = a.category AND p.i = {k} AND p.j = {k}
  JOIN g{k - 1} r ON r.category = a.category AND r.i = {k} AND r.j = a.j
  JOIN g{k - 1} f ON f.category = a.category AND f.i = a.i AND f.j = {k})""")
    sql.append(f"beta AS MATERIALIZED (SELECT category, list(v ORDER BY i) AS beta FROM g{last - 1} WHERE j = {last} GROUP BY category)")
    return ",\n".join(sql)


_SEASON = _VOL + ",\n" + _ridge("v") + """,
sd AS (SELECT category, sqrt(avg((y - list_inner_product(beta, x)) ** 2)) AS resid_std FROM ft JOIN beta USING (category) GROUP BY category)"""


@query("m05_seasonal_forecast", W(f"""
SELECT category, prediction_date, round(yhat, 4) AS yhat, CAST(greatest(round(yhat, 0), 0.0) AS INTEGER) AS predicted_volume,
       CAST(greatest(round(yhat - 1.28 * resid_std, 0), 0.0) AS INTEGER) AS lower_bound,
       CAST(greatest(round(yhat + 1.28 * resid_std, 0), 0.0) AS INTEGER) AS upper_bound
FROM (SELECT category, prediction_date, resid_std, list_inner_product(beta, {_design('prediction_date')}) AS yhat
      FROM (SELECT *, CAST(unnest(generate_series(TIMESTAMP '{FC_START}', TIMESTAMP '{FC_START + dt.timedelta(days=89)}',
                                                  INTERVAL 1 DAY)) AS DATE) AS prediction_date FROM beta JOIN sd USING (category)))""",
                                  "rl", extra=_SEASON))
def m05_seasonal_forecast(spark, sf_dir):
    """90 days ahead from the regression with a yearly season."""
    model = seasonal.fit_seasonal(forecast.daily_volumes(Ctx(spark, sf_dir).long))
    fc = seasonal.forecast_seasonal(model, FC_START, 90)
    return fc.withColumn("yhat", forecast.rnd("yhat", 4))


@query("m04_season_profile", W(f"""
SELECT category, date, round(list_inner_product(beta[9:], ({_design('date')})[9:]), 4) AS season
FROM (SELECT *, CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM beta)""",
                               "rl", extra=_SEASON))
def m04_season_profile(spark, sf_dir):
    model = seasonal.fit_seasonal(forecast.daily_volumes(Ctx(spark, sf_dir).long))
    return seasonal.season_profile(model, 1997)


_SPLIT = _VOL + """,
sp8 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date)
                    <= floor(count(*) OVER (PARTITION BY category) * 0.8::DOUBLE) AS train FROM v),
tv AS (SELECT * FROM sp8 WHERE train),
""" + _ridge("tv")


@query("m03_seasonal_holdout", f"""
WITH plain AS ({ORACLE["m03_holdout_metrics"]}),
season AS ({W(f'''
SELECT category, round(avg(abs(err)), 4) AS mae, round(sqrt(avg(err * err)), 4) AS rmse,
       round(1 - sum(err * err) / (var_pop(volume) * count(*)), 4) AS r2, count(*) AS n
FROM (SELECT category, volume, CAST(volume AS DOUBLE) - list_inner_product(beta, {_design('date')}) AS err
      FROM sp8 JOIN beta USING (category) WHERE NOT train) GROUP BY category''', "rl", extra=_SPLIT)})
SELECT 'trend_weekday' AS model, * FROM plain UNION ALL SELECT 'seasonal', * FROM season""")
def m03_seasonal_holdout(spark, sf_dir):
    """Hold-out metrics of both models, fitted on the first 80 % of a category's days."""
    return seasonal.compare_holdout(forecast.daily_volumes(Ctx(spark, sf_dir).long))


ORIGINS = [dt.date(1997 + k // 4, 1 + 3 * (k % 4), 1) for k in range(17)]       # every quarter from 1997 on
HORIZON = 28


@query("m09_rolling_origins", W(f"""
SELECT category, origin, round(avg(abs(volume - guess) / volume) * 100.0, 2) AS mape, count(*) AS days
FROM (SELECT category, origin, volume,
             CAST(greatest(round(intercept + slope * date_diff('day', DATE '2000-01-01', date) + coalesce(effect, 0.0), 0), 0.0) AS INTEGER) AS guess
      FROM v JOIN tr USING (category) LEFT JOIN ef USING (category, origin, day_of_week)
      WHERE date >= origin AND date < origin + {HORIZON} AND slope IS NOT NULL AND volume > 0) GROUP BY category, origin""", "rl", extra=f"""
v AS (SELECT CAST(opened AS DATE) AS date, category, count(*) AS volume, isodow(CAST(opened AS DATE)) AS day_of_week FROM rl GROUP BY ALL),
o AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in ORIGINS)}]) AS origin),
vo AS (SELECT v.*, origin, CAST(date_diff('day', DATE '2000-01-01', date) AS DOUBLE) AS t FROM v JOIN o ON date < origin),
tr AS (SELECT category, origin, regr_slope(volume, t) AS slope, regr_intercept(volume, t) AS intercept FROM vo GROUP BY ALL),
ef AS (SELECT category, origin, day_of_week, avg(volume - (intercept + slope * t)) AS effect
       FROM vo JOIN tr USING (category, origin) GROUP BY ALL)"""))
def m09_rolling_origins(spark, sf_dir):
    """A fit before each quarter, scored on the four weeks after it: one pass, no refit."""
    return seasonal.rolling_backtest(forecast.daily_volumes(Ctx(spark, sf_dir).long), ORIGINS, HORIZON)


RANGE_LONG = ("1996-01-17 10:30:00", "1998-11-05 08:15:00")
RANGE_SHORT = ("2024-01-05 13:45:10", "2024-01-23 02:00:30")


def _within(bounds) -> str:
    return f"opened >= TIMESTAMP '{bounds[0]}' AND opened < TIMESTAMP '{bounds[1]}'"


@query("p08_range_counts", W(f"SELECT category, district, count(*) AS count FROM rl WHERE {_within(RANGE_LONG)} GROUP BY ALL", "rl"))
def p08_range_counts(spark, sf_dir):
    """A range that begins and ends inside a day: months, days and raw edges add up to the raw count."""
    c = Ctx(spark, sf_dir)
    return ranges.range_counts(c.long, c.daily_long, c.monthly_long, *RANGE_LONG, keys=("category", "district"))


@query("p08_range_daily", W(f"SELECT CAST(opened AS DATE) AS date, count(*) AS count FROM rs WHERE {_within(RANGE_SHORT)} GROUP BY ALL", "rs"))
def p08_range_daily(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return ranges.range_daily(c.short, rollups.daily_agg(c.short), *RANGE_SHORT)


@query("p08_range_monthly", W("""SELECT strftime(opened, '%Y-%m') AS year_month, count(*) AS count FROM rl
WHERE opened >= TIMESTAMP '1996-02-10' AND opened < TIMESTAMP '1998-08-20' GROUP BY ALL""", "rl"))
def p08_range_monthly(spark, sf_dir):
    """Days as bounds: the months at the ends count from and to them."""
    c = Ctx(spark, sf_dir)
    return ranges.range_monthly(c.long, c.daily_long, c.monthly_long, "1996-02-10", "1998-08-19")


def _cube(spark, sf_dir):
    return materialize(rollups.hour_cube(Ctx(spark, sf_dir).long))


@query("a01_daily_of_cube", ORACLE["a01_daily_agg"])
def a01_daily_of_cube(spark, sf_dir):
    return rollups.daily_of_cube(_cube(spark, sf_dir))


@query("a02_monthly_of_cube", ORACLE["a02_monthly_agg"])
def a02_monthly_of_cube(spark, sf_dir):
    return rollups.monthly_of_cube(_cube(spark, sf_dir))


@query("a07_daily_of_cube", ORACLE["a07_daily_aggregates"])
def a07_daily_of_cube(spark, sf_dir):
    return rollups.daily_aggregates_of_cube(_cube(spark, sf_dir))


@query("a04_hourly_of_cube", W("""
SELECT CAST(hour(opened) AS INTEGER) AS hour, CAST(isodow(opened) - 1 AS INTEGER) AS day_of_week, category, count(*) AS count
FROM rs GROUP BY ALL""", "rs"))
def a04_hourly_of_cube(spark, sf_dir):
    return rollups.hourly_of_cube(materialize(rollups.hour_cube(Ctx(spark, sf_dir).short)))


#: Six and a half deviations of the sketch's rank error, so that a window outside means a fault.
BOUND = 2.5 * jobs.sketch_error(200)


def _sketch_sql(width: str) -> str:
    return f"""
SELECT time_bucket(INTERVAL {width}, ts) AS window_start, count(value) AS requests, true AS p50_within, true AS p95_within,
       true AS p99_within FROM events WHERE value IS NOT NULL GROUP BY 1"""


@query("t03_latency_sketch", _sketch_sql("1 day"))
def t03_latency_sketch(spark, sf_dir):
    """P50, P95 and P99 of a day from a sketch of size 200: each lies within the stated rank error."""
    rows = jobs.monitoring_rows(read_table(spark, sf_dir, "events"))
    found = jobs.sketch_percentiles(jobs.latency_sketches(rows, "1 day", 200)).drop("requests")
    return jobs.ranks_within(rows, found, "1 day", BOUND)


@query("t03_latency_sketch_merged", _sketch_sql("1 day"))
def t03_latency_sketch_merged(spark, sf_dir):
    """The same from sketches of an hour, merged to days without the rows."""
    rows = jobs.monitoring_rows(read_table(spark, sf_dir, "events"))
    hours = jobs.latency_sketches(rows, "1 hour", 200)
    found = jobs.sketch_percentiles(jobs.merged_sketches(hours, "1 day", 200)).drop("requests")
    return jobs.ranks_within(rows, found, "1 day", BOUND)


@query("p17_equal_rows", W("""
SELECT category, count(*) AS rows, count(*) AS ids, count(*) AS last_copy FROM rs GROUP BY category""", "rs"))
def p17_equal_rows(spark, sf_dir):
    """A load without ids in which all rows of a category are equal: each gets an id of its own.

    The ids are told apart in tasks of a bounded number of rows (ids of equal rows shrink in a shuffle)."""
    rows = Ctx(spark, sf_dir).short.select("category", F.lit("Open").alias("status"))
    loaded = normalize.load_projection(rows).repartition(tasks_for(rows), "case_id")
    copy = F.element_at(F.split("case_id", "-"), -1).cast("long")
    return loaded.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("case_id").alias("ids"),
                                          F.max(copy).alias("last_copy"))


@query("m05_forecast_gbt", W("""
SELECT category, CAST(unnest(generate_series(TIMESTAMP '2001-08-02', TIMESTAMP '2001-08-15', INTERVAL 1 DAY)) AS DATE) AS prediction_date,
       true AS in_order FROM (SELECT category FROM ff GROUP BY category HAVING count(*) >= 100)""", "rl", extra=_FEAT))
def m05_forecast_gbt(spark, sf_dir):
    """Two weeks ahead from trained trees (a small forest): every modelled category and day, bounds in order."""
    c = Ctx(spark, sf_dir)
    features = forecast.volume_features(c.long)
    model, pred = forecast.train_gbt(features, max_iter=5, max_depth=3, min_rows=100)
    meta = forecast.model_metadata("gbt", features, pred, dt.datetime(2001, 8, 1))
    fc = forecast.forecast_gbt(model, forecast.daily_volumes(c.long), meta, FC_START, 14)
    order = (F.col("lower_bound") >= 0) & (F.col("lower_bound") <= F.col("predicted_volume")) & (
        F.col("predicted_volume") <= F.col("upper_bound"))
    return fc.select("category", "prediction_date", order.alias("in_order"))


@query("m07_neighbourhoods", W("""
SELECT a.lat_id, a.lon_id, a.volume, CAST(sum(b.volume) AS BIGINT) AS around, count(*) AS cells,
       round((sum(b.volume) - any_value(s) / any_value(n) * count(*)) / nullif(sqrt(greatest(any_value(n * q - s * s), 0.0)) / any_value(n)
             * sqrt((any_value(n) * count(*) - count(*) * count(*)) / (any_value(n) - 1)), 0), 4) AS z
FROM cells a JOIN cells b ON abs(a.lat_id - b.lat_id) <= 1 AND abs(a.lon_id - b.lon_id) <= 1,
     (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(volume) AS DOUBLE) AS s, CAST(sum(volume * volume) AS DOUBLE) AS q FROM cells)
GROUP BY a.lat_id, a.lon_id, a.volume""", "rs", extra=_GRID + """,
cells AS (SELECT lat_id, lon_id, CAST(sum(count) AS BIGINT) AS volume FROM g GROUP BY ALL)"""))
def m07_neighbourhoods(spark, sf_dir):
    """Each grid cell against its neighbours: the local z-score."""
    return geo.neighbourhood_hotspots(rollups.grid_agg(Ctx(spark, sf_dir).short))


@query("s11_observed_metadata", ORACLE["s11_rollup_metadata"])
def s11_observed_metadata(spark, sf_dir):
    """Metadata of the rollups from the writes that store them."""
    c = Ctx(spark, sf_dir)
    return sinks.write_with_metadata({
        "daily_agg": c.daily_long, "monthly_agg": c.monthly_long, "hourly_agg": rollups.hourly_agg(c.long),
        "grid_agg": rollups.grid_agg(c.short), "resolution_agg": rollups.resolution_agg(c.long, exact=False),
        "recent_raw": rollups.recent_raw(c.long)}, folder(spark))


@query("s12_observed_report", ORACLE["s12_validation_report"])
def s12_observed_report(spark, sf_dir):
    """The validation report from the writes that store the side tables."""
    c = Ctx(spark, sf_dir)
    return sinks.write_with_report({
        "events": c.events.withColumnRenamed("event_date", "date"), "closures": c.closures.withColumnRenamed("closure_date", "date"),
        "permits": c.permits, "crime": c.crime, "weather": c.weather}, folder(spark))


@query("a07_span_areas", W("""
SELECT category, count(*) AS count, count(DISTINCT district) AS district_distinct FROM rl
WHERE opened >= TIMESTAMP '1996-02-10' AND opened < TIMESTAMP '1997-05-04' GROUP BY category""", "rl"))
def a07_span_areas(spark, sf_dir):
    """Distinct districts over 15 months from daily sketches."""
    daily = materialize(rollups.daily_sketches(Ctx(spark, sf_dir).long, "district"))
    return rollups.span_distinct(daily, ("district",), start="1996-02-10", end="1997-05-03")


@query("a12_span_cases", W("""
SELECT date, count(*) AS count, true AS merged_is_direct, true AS within FROM (SELECT CAST(opened AS DATE) AS date FROM rs) GROUP BY date
UNION ALL SELECT NULL, count(*), true, true FROM rs""", "rs"))
def a12_span_cases(spark, sf_dir):
    """Distinct cases by day and over all days from sketches by day and category: equal to a sketch of the rows,
    and within four standard errors of the exact number."""
    req = Ctx(spark, sf_dir).short
    daily = materialize(rollups.daily_sketches(req, "case_id"))
    merged = rollups.span_distinct(daily, ("case_id",), ("date",)).unionByName(
        rollups.span_distinct(daily, ("case_id",), ()).withColumn("date", F.lit(None).cast("date")))
    rows = req.select(F.explode(F.array(F.to_date("opened"), F.lit(None).cast("date"))).alias("date"), "case_id")
    direct = rows.groupBy("date").agg(F.hll_sketch_estimate(F.hll_sketch_agg("case_id", F.lit(rollups.SKETCH_LG))).alias("direct"),
                                      F.count_distinct("case_id").alias("exact")).withColumnRenamed("date", "day")
    j = merged.join(direct, F.col("date").eqNullSafe(F.col("day")))
    return j.select("date", "count", (F.abs(F.col("case_id_distinct") - F.col("direct")) <= 0.02 * F.col("exact")).alias("merged_is_direct"),
                    (F.abs(F.col("case_id_distinct") - F.col("exact")) <= 4 * 0.0163 * F.col("exact")).alias("within"))

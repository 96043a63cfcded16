"""Registered queries: batch twins of the streaming / monitoring jobs (T-*)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import forecast
from ..sources.tables import read_table
from ..streaming import jobs
from .catalog import ORACLE, query
from .context import Ctx
from .oracle_views import with_views as W
from .q_model import FC_START, _fc_sql, _model

AS_OF = dt.datetime(2024, 2, 1)

_MON = """
mon AS (SELECT ts, event_type = 'error' AS is_error, value AS latency_ms FROM events),
wm AS (SELECT time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS requests,
              CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS errors, avg(latency_ms) AS lat
       FROM mon GROUP BY 1),
wmo AS (SELECT window_start, requests, errors, round(errors / requests, 4) AS error_rate,
               round(lat, 2) AS mean_latency_ms FROM wm)"""


def _with_mon(body: str) -> str:
    return f"WITH {_MON.strip()}\n{body}"


def _mon(c: Ctx):
    return jobs.monitoring_rows(read_table(c.spark, c.sf_dir, "events"))


@query("t01_daily_windows", W("""
SELECT CAST(opened AS DATE) AS date, category, district, count(*) AS count,
       round(sum(resolution_hours), 4) AS resolution_sum, count(resolution_hours) AS resolution_n
FROM rs GROUP BY ALL""", "rs"))
def t01_daily_windows(spark, sf_dir):
    d = jobs.daily_windows(Ctx(spark, sf_dir).short)
    return d.withColumn("resolution_sum", rnd("resolution_sum", 4))


@query("t02_window_metrics", _with_mon("SELECT * FROM wmo"))
def t02_window_metrics(spark, sf_dir):
    return jobs.window_metrics(_mon(Ctx(spark, sf_dir)))


@query("t02_sustained_alerts", _with_mon("""
SELECT min(window_start) AS alert_start, max(window_start) AS last_window, count(*) AS windows,
       max(error_rate) AS peak_rate
FROM (SELECT window_start, error_rate,
             CAST(floor(epoch_us(window_start) / 60000000) AS BIGINT)
               - row_number() OVER (ORDER BY window_start) AS island
      FROM wmo WHERE error_rate > 0.05)
GROUP BY island HAVING count(*) >= 5"""))
def t02_sustained_alerts(spark, sf_dir):
    return jobs.sustained_alerts(jobs.window_metrics(_mon(Ctx(spark, sf_dir))))


@query("t02_sustained_alerts_pairs", ORACLE["t02_sustained_alerts"].replace("count(*) >= 5", "count(*) >= 2"))
def t02_sustained_alerts_pairs(spark, sf_dir):
    """Runs of two minutes, which the test data have at every size."""
    return jobs.sustained_alerts(jobs.window_metrics(_mon(Ctx(spark, sf_dir))), min_windows=2)


@query("t02_sustained_alerts_hourly", """
WITH mon AS (SELECT ts, event_type = 'error' AS is_error FROM events),
wm AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests,
              CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM mon GROUP BY 1),
wmo AS (SELECT window_start, round(errors / requests, 4) AS error_rate FROM wm)
SELECT min(window_start) AS alert_start, max(window_start) AS last_window, count(*) AS windows,
       max(error_rate) AS peak_rate
FROM (SELECT window_start, error_rate,
             CAST(floor(epoch_us(window_start) / 3600000000) AS BIGINT)
               - row_number() OVER (ORDER BY window_start) AS island
      FROM wmo WHERE error_rate > 0.25)
GROUP BY island HAVING count(*) >= 3""")
def t02_sustained_alerts_hourly(spark, sf_dir):
    m = jobs.window_metrics(_mon(Ctx(spark, sf_dir)), "1 hour")
    return jobs.sustained_alerts(m, threshold=0.25, min_windows=3, width_s=3600)


@query("t03_latency_percentiles", _with_mon("""
SELECT time_bucket(INTERVAL 60 SECOND, ts) AS window_start,
       quantile_disc(CAST(round(latency_ms * 100) AS BIGINT), 0.5) / 100.0 AS p50_ms,
       quantile_disc(CAST(round(latency_ms * 100) AS BIGINT), 0.95) / 100.0 AS p95_ms,
       quantile_disc(CAST(round(latency_ms * 100) AS BIGINT), 0.99) / 100.0 AS p99_ms
FROM mon WHERE latency_ms IS NOT NULL GROUP BY 1"""))
def t03_latency_percentiles(spark, sf_dir):
    return jobs.latency_percentiles(_mon(Ctx(spark, sf_dir)))


@query("t04_rolling_slo", _with_mon("""
SELECT date, total, good,
       round(sum(good) OVER w / sum(total) OVER w, 4) AS latency_slo,
       round(sum(ok) OVER w / sum(total) OVER w, 4) AS availability
FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS total,
             CAST(sum(CASE WHEN latency_ms < 1000.0 THEN 1 ELSE 0 END) AS BIGINT) AS good,
             CAST(sum(CASE WHEN NOT is_error THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM mon GROUP BY 1)
WINDOW w AS (ORDER BY date_diff('day', DATE '1970-01-01', date) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def t04_rolling_slo(spark, sf_dir):
    return jobs.rolling_slo(_mon(Ctx(spark, sf_dir)))


@query("t05_freshness_gauge", """
SELECT 'events' AS dataset, max(ts) AS last_ts,
       CAST(floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 1e6) AS BIGINT) AS seconds_since
FROM events
UNION ALL SELECT 'crime', max(l_shipdate),
       CAST(floor(date_diff('microsecond', max(l_shipdate), TIMESTAMP '2024-02-01') / 1e6) AS BIGINT) FROM lineitem""")
def t05_freshness_gauge(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"))
    return jobs.freshness_gauge({"events": read_table(spark, sf_dir, "events"), "crime": li}, AS_OF)


@query("t06_labelled_counters", W("""
SELECT category, 'trend_weekday' AS model_used, count(*) AS predictions,
       CAST(sum(predicted_volume) AS BIGINT) AS predicted_volume
FROM fco GROUP BY category""", "rl", extra=_fc_sql(FC_START, 30)))
def t06_labelled_counters(spark, sf_dir):
    model, effects = _model(Ctx(spark, sf_dir))
    fc = forecast.forecast(model, effects, FC_START, 30)
    preds = forecast.predictions_table(fc, "trend_weekday", "v1", dt.datetime(2001, 8, 1))
    return jobs.labelled_counters(preds)

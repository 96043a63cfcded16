"""Registered queries: forecasting features, models and forecasts (M-*, W-01 .. W-05)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import events, forecast
from .catalog import query
from .context import Ctx
from .oracle_views import with_views as W

FC_START = dt.date(2001, 8, 2)
BT_START = dt.date(2001, 6, 1)

_VOL = """
v AS (SELECT CAST(opened AS DATE) AS date, category, count(*) AS volume FROM rl GROUP BY ALL)"""

_FEAT = _VOL + """,
f AS (SELECT date, category, volume,
             CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
             CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
             CAST(weekofyear(date) AS INTEGER) AS week_of_year,
             CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(quarter(date) AS INTEGER) AS quarter,
             CAST(lag(volume, 1) OVER w AS DOUBLE) AS lag_1d, CAST(lag(volume, 7) OVER w AS DOUBLE) AS lag_7d,
             CAST(lag(volume, 14) OVER w AS DOUBLE) AS lag_14d, CAST(lag(volume, 30) OVER w AS DOUBLE) AS lag_30d,
             avg(volume) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7d,
             avg(volume) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS rolling_mean_14d,
             avg(volume) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_mean_30d
      FROM v WINDOW w AS (PARTITION BY category ORDER BY date)),
ff AS (SELECT * FROM f WHERE lag_1d IS NOT NULL AND lag_7d IS NOT NULL AND lag_14d IS NOT NULL
         AND lag_30d IS NOT NULL)"""

_MODEL = _VOL + """,
vt AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS t FROM v WHERE {fit_filter}),
tr AS (SELECT category, regr_slope(volume, t) AS slope, regr_intercept(volume, t) AS intercept, count(*) AS n_days
       FROM vt GROUP BY category),
r AS (SELECT vt.*, tr.slope, tr.intercept, volume - (intercept + slope * t) AS resid,
             CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM vt JOIN tr USING (category)),
e AS (SELECT category, day_of_week, avg(resid) AS effect FROM r GROUP BY ALL),
sp AS (SELECT category, stddev_pop(resid - effect) AS resid_std FROM r JOIN e USING (category, day_of_week)
       GROUP BY category),
m AS (SELECT * FROM tr LEFT JOIN sp USING (category))"""


def _model_sql(fit_before: dt.date | None = None) -> str:
    return _MODEL.replace("{fit_filter}", f"date < DATE '{fit_before}'" if fit_before else "TRUE")


def _fc_sql(start: dt.date, days: int, fit_before: dt.date | None = None) -> str:
    end = start + dt.timedelta(days=days - 1)
    return _model_sql(fit_before) + f""",
cal AS (SELECT category, slope, intercept, resid_std,
               CAST(unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 DAY)) AS DATE)
                 AS prediction_date FROM m),
fc AS (SELECT c.category, c.prediction_date,
              intercept + slope * CAST(date_diff('day', DATE '1970-01-01', prediction_date) AS DOUBLE)
                + coalesce(e.effect, 0.0) AS yhat, 1.28 * coalesce(resid_std, 0.0) AS band
       FROM cal c LEFT JOIN e ON c.category = e.category
         AND CAST(isodow(c.prediction_date) - 1 AS INTEGER) = e.day_of_week),
fco AS (SELECT category, prediction_date, yhat,
               CAST(greatest(round(yhat, 0), 0.0) AS INTEGER) AS predicted_volume,
               CAST(greatest(round(yhat - band, 0), 0.0) AS INTEGER) AS lower_bound,
               CAST(greatest(round(yhat + band, 0), 0.0) AS INTEGER) AS upper_bound FROM fc)"""


def _model(c: Ctx, fit_before: dt.date | None = None):
    if fit_before is None:
        return c.trend_model
    v = forecast.daily_volumes(c.long)
    if fit_before is not None:
        v = v.where(F.col("date") < F.lit(fit_before))
    return forecast.fit_trend_weekday(v)


@query("m01_volume_features", W("SELECT * FROM ff", "rl", extra=_FEAT))
def m01_volume_features(spark, sf_dir):
    return forecast.volume_features(Ctx(spark, sf_dir).long)


_DENSE = _FEAT.replace("""v AS (SELECT CAST(opened AS DATE) AS date, category, count(*) AS volume FROM rl GROUP BY ALL)""",
                        """v0 AS (SELECT CAST(opened AS DATE) AS date, category, count(*) AS volume FROM rl GROUP BY ALL),
span AS (SELECT category, min(date) AS d0, max(date) AS d1 FROM v0 GROUP BY category),
grid AS (SELECT category, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP),
                                                      INTERVAL 1 DAY)) AS DATE) AS date FROM span),
v AS (SELECT g.date, g.category, coalesce(v0.volume, 0) AS volume FROM grid g LEFT JOIN v0 USING (category, date))""")


@query("m01_volume_features_dense", W("SELECT * FROM ff", "rl", extra=_DENSE))
def m01_volume_features_dense(spark, sf_dir):
    return forecast.volume_features(Ctx(spark, sf_dir).long, densify=True)


_NO_LEAK = (_FEAT.replace("ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING")
            .replace("ROWS BETWEEN 13 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING")
            .replace("ROWS BETWEEN 29 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING")
            .replace("AND lag_30d IS NOT NULL)", """AND lag_30d IS NOT NULL
         AND rolling_mean_7d IS NOT NULL AND rolling_mean_14d IS NOT NULL AND rolling_mean_30d IS NOT NULL)"""))


@query("m01_volume_features_no_leak", W("SELECT * FROM ff", "rl", extra=_NO_LEAK))
def m01_volume_features_no_leak(spark, sf_dir):
    """Rolling means over the days *before* the current one."""
    return forecast.volume_features(Ctx(spark, sf_dir).long, exclude_current=True)


@query("w05_time_split", W("""
SELECT category, date, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY date)
                              <= floor(count(*) OVER (PARTITION BY category) * 0.8::DOUBLE)
                            THEN 'train' ELSE 'validation' END AS split
FROM ff""", "rl", extra=_FEAT))
def w05_time_split(spark, sf_dir):
    return forecast.time_split(forecast.volume_features(Ctx(spark, sf_dir).long)).select("category", "date", "split")


@query("m04_trend_weekday_model", W("""
SELECT category, round(slope, 8) AS slope, round(intercept, 4) AS intercept, n_days, round(resid_std, 4) AS resid_std
FROM m""", "rl", extra=_model_sql()))
def m04_trend_weekday_model(spark, sf_dir):
    model, _ = _model(Ctx(spark, sf_dir))
    return model.select("category", rnd("slope", 8).alias("slope"), rnd("intercept", 4).alias("intercept"),
                        "n_days", rnd("resid_std", 4).alias("resid_std"))


@query("m03_fit_metrics", W("""
SELECT category, round(avg(abs(err)), 4) AS mae, round(sqrt(avg(err * err)), 4) AS rmse,
       round(1 - sum(err * err) / (var_pop(volume) * count(*)), 4) AS r2, count(*) AS n
FROM (SELECT r.category, r.volume, CAST(r.volume AS DOUBLE) - (r.intercept + r.slope * r.t + e.effect) AS err
      FROM r JOIN e USING (category, day_of_week)) GROUP BY category""", "rl", extra=_model_sql()))
def m03_fit_metrics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    model, effects = _model(c)
    v = forecast.daily_volumes(c.long).withColumn("day_of_week", F.weekday("date"))
    pred = v.join(model, "category").join(effects, ["category", "day_of_week"]).withColumn(
        "prediction", F.col("intercept") + F.col("slope") * forecast.day_number(F.col("date")).cast("double")
        + F.col("effect"))
    return forecast.regression_metrics(pred, ["category"])


_HOLDOUT = _VOL + """,
sp8 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date)
                    <= floor(count(*) OVER (PARTITION BY category) * 0.8::DOUBLE) AS train,
               CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS t,
               CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM v),
tr AS (SELECT category, regr_slope(volume, t) AS slope, regr_intercept(volume, t) AS intercept
       FROM sp8 WHERE train GROUP BY category),
r AS (SELECT sp8.*, intercept + slope * t AS base FROM sp8 JOIN tr USING (category)),
e AS (SELECT category, day_of_week, avg(volume - base) AS effect FROM r WHERE train GROUP BY ALL),
p AS (SELECT r.category, r.date, r.train, r.volume, base + coalesce(effect, 0.0) AS yhat
      FROM r LEFT JOIN e USING (category, day_of_week))"""


@query("m03_holdout_metrics", W("""
SELECT category, round(avg(abs(volume - yhat)), 4) AS mae, round(sqrt(avg((volume - yhat) * (volume - yhat))), 4) AS rmse,
       round(1 - sum((volume - yhat) * (volume - yhat)) / (var_pop(volume) * count(*)), 4) AS r2, count(*) AS n
FROM p WHERE NOT train GROUP BY category""", "rl", extra=_HOLDOUT))
def m03_holdout_metrics(spark, sf_dir):
    """Fitted on the first 80 % of a category's days, scored on the last 20 %."""
    return forecast.holdout_metrics(forecast.daily_volumes(Ctx(spark, sf_dir).long))


@query("m04_yearly_effects", W("""
SELECT category, CAST(month(date) AS INTEGER) AS month, round(avg(volume - (intercept + slope * t + effect)), 4) AS month_effect
FROM r JOIN e USING (category, day_of_week) GROUP BY ALL""", "rl", extra=_model_sql()))
def m04_yearly_effects(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    effects = forecast.yearly_effects(forecast.daily_volumes(c.long), *_model(c))
    return effects.select("category", "month", rnd("month_effect", 4).alias("month_effect"))


@query("m05_forecast", W("""
SELECT category, prediction_date, predicted_volume, lower_bound, upper_bound FROM fco""", "rl",
                         extra=_fc_sql(FC_START, 30)))
def m05_forecast(spark, sf_dir):
    model, effects = _model(Ctx(spark, sf_dir))
    return forecast.forecast(model, effects, FC_START, 30).drop("yhat")


@query("m06_trend_summary", W("""
SELECT category, CASE WHEN last > first THEN 'increasing' ELSE 'decreasing' END AS direction,
       round(abs((last - first) / nullif(first, 0) * 100.0), 2) AS magnitude_percent,
       CAST(trunc(total) AS BIGINT) AS predicted_total, CAST(trunc(mean) AS BIGINT) AS daily_average
FROM (SELECT category, arg_min(yhat, prediction_date) AS first, arg_max(yhat, prediction_date) AS last,
             sum(yhat) AS total, avg(yhat) AS mean FROM fco GROUP BY category)""", "rl",
                              extra=_fc_sql(FC_START, 30)))
def m06_trend_summary(spark, sf_dir):
    model, effects = _model(Ctx(spark, sf_dir))
    return forecast.trend_summary(forecast.forecast(model, effects, FC_START, 30))


@query("m09_backtest", W("""
SELECT category, round(avg(abs(volume - predicted_volume) / volume) * 100.0, 2) AS mape, count(*) AS days
FROM fco JOIN (SELECT category, date AS prediction_date, volume FROM v) a USING (category, prediction_date)
WHERE volume > 0 GROUP BY category""", "rl", extra=_fc_sql(BT_START, 61, fit_before=BT_START)))
def m09_backtest(spark, sf_dir):
    """True hold-out: the model sees only days before the 61 scored days."""
    c = Ctx(spark, sf_dir)
    model, effects = _model(c, fit_before=BT_START)
    preds = forecast.forecast(model, effects, BT_START, 61)
    return forecast.backtest(preds, forecast.daily_volumes(c.long))


@query("m10_external_features", W("""
SELECT ff.date, ff.category, ff.volume, coalesce(w.precip_mm, 0.0) AS precip_mm, coalesce(w.rain_day, 0) AS rain_day,
       coalesce(e.event_count, 0) AS event_count, coalesce(e.street_closure_count, 0) AS street_closure_count,
       coalesce(e.construction_count, 0) AS construction_count, coalesce(c.incident_count, 0) AS incident_count
FROM ff LEFT JOIN weather w USING (date) LEFT JOIN events_agg e USING (date)
LEFT JOIN (SELECT date, CAST(sum(count) AS BIGINT) AS incident_count FROM crime_agg GROUP BY 1) c USING (date)""",
                                   "rl", "weather", "events_agg", "crime_agg", extra=_FEAT))
def m10_external_features(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    f = forecast.with_external(forecast.volume_features(c.long), c.weather, c.events_agg,
                               events.crime_daily(c.crime_agg))
    return f.select("date", "category", "volume", "precip_mm", "rain_day", "event_count", "street_closure_count",
                    "construction_count", "incident_count")


@query("m02_gbt_validation_metrics")
def m02_gbt_validation_metrics(spark, sf_dir):
    """Rows-only check: a boosted-tree fit has no SQL equivalent."""
    from ..operators import volume
    c = Ctx(spark, sf_dir)
    top10 = volume.top_k(c.long, "category", 10)
    _, pred = forecast.train_gbt(forecast.volume_features(c.long), categories=top10, min_rows=100)
    return forecast.regression_metrics(pred, ["category"])


@query("m02_gbt_split", W("""
SELECT category, CAST(sum(CASE WHEN train THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN train THEN 0 ELSE 1 END) AS BIGINT) AS validation_rows,
       min(date) FILTER (WHERE NOT train) AS split_date, count(*) FILTER (WHERE NOT train) AS scored_rows
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date)
                  <= floor(count(*) OVER (PARTITION BY category) * 0.8::DOUBLE) AS train,
             count(*) OVER (PARTITION BY category) AS days FROM ff)
WHERE days >= 100 GROUP BY category""", "rl", extra=_FEAT))
def m02_gbt_split(spark, sf_dir):
    """What SQL can state of the boosted trees: their categories, the split, and that
    every validation day got a finite prediction (a small forest, fitted here)."""
    c = Ctx(spark, sf_dir)
    features = forecast.volume_features(c.long)
    _, pred = forecast.train_gbt(features, max_iter=5, max_depth=3, min_rows=100)
    scored = pred.where(~F.isnan("prediction") & (F.abs("prediction") < float("inf"))).groupBy("category").agg(
        F.count(F.lit(1)).alias("scored_rows"))
    split = forecast.model_metadata("gbt", features, pred, dt.datetime(2001, 8, 1))
    return split.join(scored, "category").select("category", "train_rows", "validation_rows", "split_date", "scored_rows")


@query("m08_predictions_table", W("""
SELECT sha256(concat_ws('|', category, strftime(prediction_date, '%Y-%m-%d'), 'trend_weekday', 'v1'))
         AS prediction_id,
       TIMESTAMP '2001-08-01 00:00:00' AS generated_at, category, prediction_date, predicted_volume, lower_bound,
       upper_bound, 'trend_weekday' AS model_used, 'v1' AS model_version, CAST(NULL AS DOUBLE) AS confidence
FROM fco""", "rl", extra=_fc_sql(FC_START, 30)))
def m08_predictions_table(spark, sf_dir):
    model, effects = _model(Ctx(spark, sf_dir))
    fc = forecast.forecast(model, effects, FC_START, 30)
    return forecast.predictions_table(fc, "trend_weekday", "v1", dt.datetime(2001, 8, 1))

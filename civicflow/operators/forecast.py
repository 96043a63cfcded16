"""Volume modelling and forecasting: M-01 .. M-10, W-01 .. W-03, W-05.

Every step works on the daily (category, date) volume table -- one row per
category and day, so each category's series is bounded by the calendar and
per-category windows never see raw rows. Models are Spark ML (distributed
fit) or closed-form aggregates (``regr_slope`` etc.), never a per-category
driver loop.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import ts_lit
from ..functions.numeric import rnd

LAGS = (1, 7, 14, 30)
ROLLING = (7, 14, 30)
CALENDAR = ["year", "month", "day", "day_of_week", "week_of_year", "is_weekend", "quarter"]
EPOCH = dt.date(1970, 1, 1)
BAND_Z = 1.28     # ~80 % two-sided normal band for lower/upper bounds (our definition)


def daily_volumes(req: DataFrame) -> DataFrame:
    """(date, category, volume) over days having rows (partial aggregate)."""
    return req.groupBy(F.to_date("opened").alias("date"), "category").agg(F.count(F.lit(1)).alias("volume"))


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
                           "day_of_week": F.weekday(d), "week_of_year": F.weekofyear(d),
                           "is_weekend": (F.weekday(d) >= 5).cast("int"), "quarter": F.quarter(d)})


def dense_volumes(req: DataFrame) -> DataFrame:
    """Daily volumes with every calendar day between a category's first and
    last day present (0-filled). Each category row generates its own calendar
    (``explode(sequence)``), bounded by the days in its span."""
    v = daily_volumes(req)
    span = v.groupBy("category").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    grid = span.select("category", F.explode(F.sequence("d0", "d1")).alias("date"))
    return grid.join(v, ["category", "date"], "left").withColumn(
        "volume", F.coalesce(F.col("volume"), F.lit(0).cast("long")))


def volume_features(req: DataFrame, lags=LAGS, windows=ROLLING, exclude_current: bool = False,
                    dropna: bool = True, densify: bool = False) -> DataFrame:
    """M-01: daily volume + calendar (P-03) + W-01 lags + W-02 rolling means.

    Lags count rows (days with data), like the reference, unless ``densify``
    (then days without rows are 0 and lags are calendar days). Rolling means
    use ``min_periods=1`` and include the current day unless
    ``exclude_current``. W-03: rows with a missing lag are dropped when ``dropna``.
    """
    v = with_calendar(dense_volumes(req) if densify else daily_volumes(req))
    w = Window.partitionBy("category").orderBy("date")
    cols = {f"lag_{n}d": F.lag("volume", n).over(w).cast("double") for n in lags}
    for n in windows:
        frame = w.rowsBetween(-n, -1) if exclude_current else w.rowsBetween(-(n - 1), 0)
        cols[f"rolling_mean_{n}d"] = F.avg("volume").over(frame)
    out = v.withColumns(cols)
    if dropna:
        out = out.dropna(subset=[f"lag_{n}d" for n in lags] + [f"rolling_mean_{n}d" for n in windows])
    return out


def feature_columns(lags=LAGS, windows=ROLLING) -> list[str]:
    return CALENDAR + [f"lag_{n}d" for n in lags] + [f"rolling_mean_{n}d" for n in windows]


def time_split(features: DataFrame, frac: float = 0.8) -> DataFrame:
    """W-05: per category, the first ``int(n * frac)`` days (time order) are 'train', the rest 'validation'."""
    w = Window.partitionBy("category")
    rn = F.row_number().over(w.orderBy("date"))
    cut = F.floor(F.count(F.lit(1)).over(w) * F.lit(frac))
    return features.withColumn("split", F.when(rn <= cut, "train").otherwise("validation"))


def regression_metrics(pred: DataFrame, keys: list[str], label: str = "volume",
                       prediction: str = "prediction") -> DataFrame:
    """M-03: mae, rmse, r2 (4 dp) per key, as plain aggregates."""
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    agg = pred.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                                  F.sum(err * err).alias("ss_res"),
                                  (F.var_pop(F.col(label).cast("double")) * F.count(F.lit(1))).alias("ss_tot"),
                                  F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, rnd("mae", 4).alias("mae"), rnd(F.sqrt("mse"), 4).alias("rmse"),
                      rnd(1 - F.try_divide(F.col("ss_res"), F.col("ss_tot")), 4).alias("r2"), "n")


# ------------------------------------------------------------------ M-04 / M-05
def day_number(d) -> F.Column:
    return F.datediff(d, F.lit(EPOCH))


def fit_trend_weekday(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M-04: per category ``volume ~ intercept + slope * t + weekday effect``.

    Trend by least squares (``regr_slope`` / ``regr_intercept`` aggregates);
    weekday effect = mean de-trended residual per weekday; ``resid_std`` =
    population std of the remaining residual. Returns (model, weekday_effects).
    """
    v = volumes.withColumn("t", day_number(F.col("date")).cast("double"))
    trend = v.groupBy("category").agg(F.regr_slope("volume", "t").alias("slope"),
                                      F.regr_intercept("volume", "t").alias("intercept"),
                                      F.count(F.lit(1)).alias("n_days"))
    r = v.join(trend, "category").withColumns({
        "resid": F.col("volume") - (F.col("intercept") + F.col("slope") * F.col("t")),
        "day_of_week": F.weekday("date")})
    effects = r.groupBy("category", "day_of_week").agg(F.avg("resid").alias("effect"))
    spread = (r.join(effects, ["category", "day_of_week"])          # <= 7 effect rows per category
              .groupBy("category").agg(F.stddev_pop(F.col("resid") - F.col("effect")).alias("resid_std")))
    model = trend.join(spread, "category", "left")
    return model, effects


def yearly_effects(volumes: DataFrame, model: DataFrame, effects: DataFrame) -> DataFrame:
    """M-04, yearly term: per category and month of the year the mean of what trend and
    weekday leave over (``month_effect``)."""
    left = fitted(volumes, model, effects).withColumn("_left", F.col("volume") - F.col("prediction"))
    return left.groupBy("category", F.month("date").alias("month")).agg(F.avg("_left").alias("month_effect"))


def fitted(volumes: DataFrame, model: DataFrame, effects: DataFrame, yearly: DataFrame | None = None) -> DataFrame:
    """``volumes`` with the model's ``prediction`` for the same days."""
    t = day_number(F.col("date")).cast("double")
    rows = volumes.withColumn("day_of_week", F.weekday("date")).join(model, "category").join(
        effects, ["category", "day_of_week"], "left")
    value = F.col("intercept") + F.col("slope") * t + F.coalesce(F.col("effect"), F.lit(0.0))
    if yearly is not None:
        rows = rows.withColumn("month", F.month("date")).join(yearly, ["category", "month"], "left")
        value = value + F.coalesce(F.col("month_effect"), F.lit(0.0))
    return rows.select(*volumes.columns, value.alias("prediction"))


def holdout_metrics(volumes: DataFrame, yearly: bool = False) -> DataFrame:
    """M-03: the trend model fitted on each category's first 80 % of days (W-05), scored on the rest."""
    split = time_split(volumes)
    train = split.where("split = 'train'").drop("split")
    model, effects = fit_trend_weekday(train)
    extra = yearly_effects(train, model, effects) if yearly else None
    return regression_metrics(fitted(split.where("split = 'validation'"), model, effects, extra), ["category"])


def forecast(model: DataFrame, effects: DataFrame, start: dt.date, days: int) -> DataFrame:
    """M-05: per category and day in [start, start + days): yhat, predicted_volume,
    lower/upper bounds (rounded, clamped at 0)."""
    end = start + dt.timedelta(days=days - 1)
    cal = model.select("category", "slope", "intercept", "resid_std",
                       F.explode(F.sequence(F.lit(start), F.lit(end))).alias("prediction_date"))
    cal = cal.withColumn("day_of_week", F.weekday("prediction_date"))
    j = cal.join(effects, ["category", "day_of_week"], "left")     # <= 7 rows per category
    yhat = (F.col("intercept") + F.col("slope") * day_number(F.col("prediction_date")).cast("double")
            + F.coalesce(F.col("effect"), F.lit(0.0)))
    band = F.lit(BAND_Z) * F.coalesce(F.col("resid_std"), F.lit(0.0))

    def clamp(x):
        return F.greatest(F.round(x, 0), F.lit(0.0)).cast("int")

    return j.select("category", "prediction_date", yhat.alias("yhat"),
                    clamp(yhat).alias("predicted_volume"), clamp(yhat - band).alias("lower_bound"),
                    clamp(yhat + band).alias("upper_bound"))


def trend_summary(fc: DataFrame) -> DataFrame:
    """M-06: per category: direction (last vs first yhat), magnitude_percent (2 dp,
    null when the first value is 0), predicted_total and daily_average (truncated)."""
    agg = fc.groupBy("category").agg(F.min_by("yhat", "prediction_date").alias("first"),
                                     F.max_by("yhat", "prediction_date").alias("last"),
                                     F.sum("yhat").alias("total"), F.avg("yhat").alias("mean"))
    return agg.select("category",
                      F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing").alias("direction"),
                      rnd(F.abs(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100.0), 2)
                      .alias("magnitude_percent"),
                      F.col("total").cast("long").alias("predicted_total"),
                      F.col("mean").cast("long").alias("daily_average"))


def predictions_table(fc: DataFrame, model_used: str, model_version: str, generated_at: dt.datetime) -> DataFrame:
    """M-08: rows of the predictions table (write with ``partitionBy('prediction_date')``)."""
    pid = F.sha2(F.concat_ws("|", F.col("category"), F.col("prediction_date").cast("string"),
                             F.lit(model_used), F.lit(model_version)), 256)
    return fc.select(pid.alias("prediction_id"), ts_lit(generated_at).alias("generated_at"),
                     "category", "prediction_date", "predicted_volume", "lower_bound", "upper_bound",
                     F.lit(model_used).alias("model_used"), F.lit(model_version).alias("model_version"),
                     F.lit(None).cast("double").alias("confidence"))


def backtest(predictions: DataFrame, volumes: DataFrame) -> DataFrame:
    """M-09: per category MAPE (%) of predicted vs actual daily volume on days with actual > 0."""
    act = volumes.select("category", F.col("date").alias("prediction_date"), "volume")
    j = predictions.join(act, ["category", "prediction_date"], "inner").where(F.col("volume") > 0)
    ape = F.abs(F.col("volume") - F.col("predicted_volume")) / F.col("volume")
    return j.groupBy("category").agg(rnd(F.avg(ape) * 100.0, 2).alias("mape"), F.count(F.lit(1)).alias("days"))


def with_external(features: DataFrame, weather: DataFrame | None = None, events_agg: DataFrame | None = None,
                  crime_daily: DataFrame | None = None) -> DataFrame:
    """M-10: join day-keyed side features (one row per date)."""
    out = features
    if weather is not None:
        out = out.join(weather.select("date", "precip_mm", "rain_day"), "date", "left")
    if events_agg is not None:
        out = out.join(events_agg, "date", "left")
    if crime_daily is not None:
        out = out.join(crime_daily.select("date", "incident_count"), "date", "left")
    fills = {c: 0 for c in ("rain_day", "event_count", "street_closure_count", "construction_count",
                            "incident_count") if c in out.columns}
    fills.update({"precip_mm": 0.0} if "precip_mm" in out.columns else {})
    return out.fillna(fills)


# ------------------------------------------------------------------ M-02
def train_gbt(features: DataFrame, max_iter: int = 100, max_depth: int = 6, step: float = 0.1,
              subsample: float = 0.8, seed: int = 42, feature_cols: list[str] | None = None,
              categories: DataFrame | None = None, min_rows: int = 100):
    """M-02: one gradient-boosted model over the modelled categories (category
    index is a feature), fitted on the W-05 'train' rows. Returns
    (PipelineModel, predictions on the 'validation' rows).

    Modelled categories: those in ``categories`` (e.g. the top 10 by requests,
    at most k rows) that have at least ``min_rows`` feature rows.
    One distributed fit scales with data; a model per category would be a
    driver loop over groups.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cols = feature_cols or feature_columns()
    if categories is not None:
        features = features.join(categories.select("category"), "category", "left_semi")
    rows = F.count(F.lit(1)).over(Window.partitionBy("category"))       # one row per category-day
    features = features.withColumn("_rows", rows).where(F.col("_rows") >= min_rows).drop("_rows")
    split = time_split(features)
    train = split.where("split = 'train'")
    valid = split.where("split = 'validation'")
    stages = [StringIndexer(inputCol="category", outputCol="category_idx", handleInvalid="keep"),
              VectorAssembler(inputCols=cols + ["category_idx"], outputCol="features"),
              GBTRegressor(featuresCol="features", labelCol="volume", maxIter=max_iter, maxDepth=max_depth,
                           stepSize=step, subsamplingRate=subsample, featureSubsetStrategy="0.8", seed=seed,
                           maxBins=64)]
    model = Pipeline(stages=stages).fit(train.withColumn("volume", F.col("volume").cast("double")))
    pred = model.transform(valid.withColumn("volume", F.col("volume").cast("double")))
    return model, pred.drop("features")


def model_metadata(model_name: str, features: DataFrame, predictions: DataFrame, trained_at: dt.datetime,
                   frac: float = 0.8) -> DataFrame:
    """M-02: one row per modelled category: rows and days of both parts, metrics on the last part."""
    split = time_split(features.join(predictions.select("category").distinct(), "category", "left_semi"), frac)
    valid = F.col("split") == "validation"
    parts = split.groupBy("category").agg(
        F.sum((~valid).cast("long")).alias("train_rows"), F.sum(valid.cast("long")).alias("validation_rows"),
        F.min(F.when(valid, F.col("date"))).alias("split_date"), F.max("date").alias("last_date"))
    return parts.join(regression_metrics(predictions, ["category"]).drop("n"), "category").select(
        F.lit(model_name).alias("model"), ts_lit(trained_at).alias("trained_at"), "*")


def save_gbt(model, path: str, metadata: DataFrame) -> None:
    """M-02: the fitted pipeline and its metadata table, side by side."""
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_gbt(spark, path: str):
    """(fitted pipeline, metadata) as ``save_gbt`` wrote them."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")


def forecast_gbt(model, volumes: DataFrame, metadata: DataFrame, start: dt.date, days: int) -> DataFrame:
    """M-05 with the trained trees: the columns of ``forecast``.

    A future day's lag is the volume that many days earlier; where that day is
    itself in the future or has no rows, the latest earlier observed day of the
    same weekday stands in (at most ten weeks back). Rolling means are those of the last
    observed days. Bounds are +-1.28 of the validation RMSE."""
    known = volumes.join(metadata.select("category", "rmse"), "category")
    last = known.groupBy("category", "rmse").agg(F.max("date").alias("last"))
    # the last days of each category as (day, volume), at most ~100 entries
    reach = max(LAGS) + 70
    recent = (known.join(last.select("category", "last"), "category").where(F.col("date") > F.date_sub("last", reach))
              .groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("date", "volume"))).alias("seen"),
                                       F.array_sort(F.collect_list(F.struct("date", "volume"))).alias("run")))
    end = start + dt.timedelta(days=days - 1)
    grid = last.join(recent, "category").select(
        "*", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))

    def lag(n: int):
        return F.coalesce(*[F.try_element_at("seen", F.date_sub("date", n + 7 * k)) for k in range(10)],
                          F.element_at("run", -1)["volume"]).cast("double")

    def mean(n: int):
        tail = F.slice("run", F.greatest(F.size("run") - n + 1, F.lit(1)), n)
        return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x["volume"]) / F.size(tail)

    rows = with_calendar(grid).withColumns({f"lag_{n}d": lag(n) for n in LAGS} | {f"rolling_mean_{n}d": mean(n) for n in ROLLING})
    out = model.transform(rows)
    band = F.lit(BAND_Z) * F.coalesce(F.col("rmse"), F.lit(0.0))

    def clamp(x):
        return F.greatest(F.round(x, 0), F.lit(0.0)).cast("int")

    yhat = F.col("prediction")
    return out.select("category", F.col("date").alias("prediction_date"), yhat.alias("yhat"), clamp(yhat).alias("predicted_volume"),
                      clamp(yhat - band).alias("lower_bound"), clamp(yhat + band).alias("upper_bound"))

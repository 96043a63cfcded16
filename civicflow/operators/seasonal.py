"""M-04 / M-05 with a yearly season: ridge regression per category, solved from its moments.

The design of a day is a constant, the trend, six weekday indicators and Fourier terms of the
year. All that a fit needs are the sums of products of these columns over the days of a
category (Gram matrix, products with the volume), which are ordinary partial aggregates: one row per
category whatever the number of days. Each row is then solved on its own, a system of
2 + 6 + 2 * terms unknowns.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from .forecast import (BAND_Z, fit_trend_weekday, fitted, regression_metrics, time_split)

YEAR = 365.25
ORIGIN = dt.date(2000, 1, 1)      # the trend counts years from here, which keeps the system well scaled
TERMS, RIDGE = 3, 1.0


def design(day: Column, terms: int = TERMS) -> list[Column]:
    """The regression's columns for a day: 1, years since ORIGIN, Monday .. Saturday, sin and cos of the year's harmonics."""
    years = F.datediff(day, F.lit(ORIGIN)) / F.lit(YEAR)
    weekdays = [(F.weekday(day) == k).cast("double") for k in range(6)]
    waves = [f(years * (2 * math.pi * k)) for k in range(1, terms + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), years, *weekdays, *waves]


def moments(volumes: DataFrame, keys: list[str], terms: int = TERMS) -> DataFrame:
    """Per ``keys``: ``gram`` (upper triangle by rows), ``xy``, ``yy`` and ``n_days`` of the design over
    ``volumes(date, volume)``. Sums of disjoint parts add up to those of the whole."""
    x = [f"_x{k}" for k in range(8 + 2 * terms)]
    rows = volumes.select(*keys, F.col("volume").cast("double").alias("_y"),
                          *[c.alias(n) for c, n in zip(design(F.col("date"), terms), x)])
    pairs = [(a, b) for k, a in enumerate(x) for b in x[k:]]
    sums = rows.groupBy(*keys).agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"_g{k}") for k, (a, b) in enumerate(pairs)],
        *[F.sum(F.col(a) * F.col("_y")).alias(f"_b{k}") for k, a in enumerate(x)],
        F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count(F.lit(1)).alias("n_days"))
    return sums.select(*keys, F.array(*[f"_g{k}" for k in range(len(pairs))]).alias("gram"),
                       F.array(*[f"_b{k}" for k in range(len(x))]).alias("xy"), "yy", "n_days")


def solve(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, ridge: float) -> tuple[np.ndarray, float]:
    """(coefficients, standard deviation of the residuals); the constant is not penalised."""
    size = len(xy)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = gram
    full += np.triu(full, 1).T
    penalty = np.full(size, float(ridge))
    penalty[0] = 0
    beta = np.linalg.solve(full + np.diag(penalty), xy)
    return beta, math.sqrt(max(0.0, yy - 2 * beta @ xy + beta @ full @ beta) / n)


def fit_seasonal(volumes: DataFrame, terms: int = TERMS, ridge: float = RIDGE, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """``keys, beta, resid_std, n_days``: one row per category. A category of any length has a solution,
    as the penalty leaves no direction free. An empty table gives no rows."""
    @F.pandas_udf("beta array<double>, resid_std double")
    def solved(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for gram, xy, yy, n in parts:
            found = [solve(np.asarray(g), np.asarray(b), y, k, ridge) for g, b, y, k in zip(gram, xy, yy, n)]
            yield pd.DataFrame({"beta": [b.tolist() for b, _ in found], "resid_std": [s for _, s in found]})

    sums = moments(volumes, list(keys), terms)
    return sums.select(*keys, solved("gram", "xy", "yy", "n_days").alias("_fit"), "n_days").select(
        *keys, "_fit.beta", "_fit.resid_std", "n_days")


def predicted(day: Column, terms: int = TERMS) -> Column:
    """The model's value for a day, from the row's ``beta``."""
    out = F.lit(0.0)
    for k, x in enumerate(design(day, terms)):
        out = out + F.get("beta", F.lit(k)) * x
    return out


def forecast_seasonal(model: DataFrame, start: dt.date, days: int, terms: int = TERMS) -> DataFrame:
    """M-05: the columns of ``forecast.forecast`` from the seasonal model, for days in [start, start + days)."""
    end = start + dt.timedelta(days=days - 1)
    rows = model.withColumn("prediction_date", F.explode(F.sequence(F.lit(start), F.lit(end))))
    rows = rows.withColumn("yhat", predicted(F.col("prediction_date"), terms))
    band = F.lit(BAND_Z) * F.col("resid_std")

    def clamp(x: Column) -> Column:
        return F.greatest(F.round(x, 0), F.lit(0.0)).cast("int")

    return rows.select("category", "prediction_date", "yhat", clamp(F.col("yhat")).alias("predicted_volume"),
                       clamp(F.col("yhat") - band).alias("lower_bound"), clamp(F.col("yhat") + band).alias("upper_bound"))


def season_profile(model: DataFrame, year: int, terms: int = TERMS) -> DataFrame:
    """Per category and day of ``year`` the yearly part alone (4 dp): what the season adds to trend and weekday."""
    days = F.explode(F.sequence(F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year, 12, 31))))
    rows = model.withColumn("date", days)
    out = F.lit(0.0)
    for k, x in enumerate(design(F.col("date"), terms)):
        out = out + F.get("beta", F.lit(k)) * x if k >= 8 else out
    return rows.select("category", "date", rnd(out, 4).alias("season"))


def compare_holdout(volumes: DataFrame, terms: int = TERMS, ridge: float = RIDGE) -> DataFrame:
    """M-03 of both models side by side (``model, category, mae, rmse, r2, n``): fitted on each category's first
    80 % of days, scored on the rest."""
    split = time_split(volumes)
    train, rest = split.where("split = 'train'").drop("split"), split.where("split = 'validation'").drop("split")
    plain = regression_metrics(fitted(rest, *fit_trend_weekday(train)), ["category"])
    scored = rest.join(fit_seasonal(train, terms, ridge), "category").withColumn("prediction", predicted(F.col("date"), terms))
    season = regression_metrics(scored, ["category"])
    columns = ["model", "category", "mae", "rmse", "r2", "n"]
    return plain.withColumn("model", F.lit("trend_weekday")).select(*columns).unionByName(
        season.withColumn("model", F.lit("seasonal")).select(*columns))


def rolling_backtest(volumes: DataFrame, origins: list[dt.date], horizon: int) -> DataFrame:
    """M-09 over many origins in one pass: ``category, origin, mape, days``.

    For every origin the trend and weekday model is fitted on the days before it and scored on the
    ``horizon`` days from it on. The days between two origins are summed to whole-number moments once
    (count, day, volume and their products by category and weekday); running sums over the
    origins are the moments of each training set, from which slope, intercept and weekday effects follow.
    The volumes are read once, however many origins there are. Categories without two days before an
    origin have no row for it.
    """
    cuts = F.array(*[F.lit(o) for o in sorted(origins)])
    t = F.datediff("date", F.lit(ORIGIN)).cast("long")
    rows = volumes.where(F.col("category").isNotNull()).select(
        "category", "date", F.weekday("date").alias("day_of_week"), t.alias("t"), F.col("volume").cast("long").alias("y"))
    part = F.size(F.filter(cuts, lambda o: o <= F.col("date")))
    sums = ["n", "st", "sy", "stt", "sty"]
    by_part = rows.groupBy("category", "day_of_week", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("st"), F.sum("y").alias("sy"),
        F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("t") * F.col("y")).alias("sty"))
    # a row for every origin, so that running sums reach those without days since the one before
    grid = by_part.select("category", "day_of_week").distinct().withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(len(origins) - 1))))
    upto = Window.partitionBy("category", "day_of_week").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(by_part, ["category", "day_of_week", "part"], "left").select(
        "category", "day_of_week", F.get(cuts, F.col("part")).alias("origin"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0).cast("long")).alias(c) for c in sums])
    whole = Window.partitionBy("category", "origin")
    N, T, Y, TT, TY = (F.sum(c).over(whole) for c in sums)
    spread = N * TT - T * T                        # whole numbers: nothing cancels
    slope = F.try_divide((N * TY - T * Y).cast("double"), spread.cast("double"))
    line = run.withColumns({"slope": slope, "all_n": N, "all_t": T, "all_y": Y}).withColumn(
        "intercept", (F.col("all_y") - F.col("slope") * F.col("all_t")) / F.col("all_n")).where("slope IS NOT NULL")
    effect = F.try_divide(F.col("sy") - F.col("intercept") * F.col("n") - F.col("slope") * F.col("st"), F.col("n").cast("double"))
    model = line.select("category", "origin", "day_of_week", "slope", "intercept", F.coalesce(effect, F.lit(0.0)).alias("effect"))
    scored = rows.where("y > 0").withColumn("origin", F.explode(F.filter(
        cuts, lambda o: (o <= F.col("date")) & (F.col("date") < F.date_add(o, horizon)))))
    # one model row per weekday; a weekday first seen after every origin has no moments, and so no row: effect 0
    trend = model.groupBy("category", "origin").agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))
    j = scored.join(trend, ["category", "origin"]).join(
        model.select("category", "origin", "day_of_week", "effect"), ["category", "origin", "day_of_week"], "left")
    yhat = F.col("intercept") + F.col("slope") * F.col("t") + F.coalesce("effect", F.lit(0.0))
    guess = F.greatest(F.round(yhat, 0), F.lit(0.0)).cast("int")
    return j.groupBy("category", "origin").agg(rnd(F.avg(F.abs(F.col("y") - guess) / F.col("y")) * 100.0, 2).alias("mape"),
                                               F.count(F.lit(1)).alias("days"))

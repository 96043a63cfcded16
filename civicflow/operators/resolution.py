"""Resolution-time questions: A-20, A-21, A-36, A-41.

Medians are exact and skew-safe (``selection.exact_median``); averages and
counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sort_small
from ..functions.numeric import pct, ratio, rnd
from ..constants import RESOLUTION_MAX_HOURS
from . import filters
from ..session import materialize
from .rollups import resolution_micros
from .selection import exact_median

US_PER_HOUR = 3.6e9


def _valid(req: DataFrame, keys: list[str]) -> DataFrame:
    """Valid rows projected to (keys, res_us, resolution_hours), materialised
    once for the mean pass and the three median passes."""
    df = materialize(resolution_micros(filters.valid_resolution(req)).select(*keys, "res_us"))
    return df.withColumn("resolution_hours", F.col("res_us") / F.lit(US_PER_HOUR))


def _stats(df: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    if not exact:       # one pass; rank error <= n / 10000 per group
        return df.groupBy(*keys).agg(F.avg("resolution_hours").alias("avg_h"), F.count(F.lit(1)).alias("n"),
                                     F.percentile_approx("resolution_hours", 0.5, 10000).alias("med_h"))
    agg = df.groupBy(*keys).agg(F.avg("resolution_hours").alias("avg_h"), F.count(F.lit(1)).alias("n"))
    med = exact_median(df, keys, "res_us", below=int(RESOLUTION_MAX_HOURS * US_PER_HOUR))     # valid rows only
    med = med.withColumn("med_h", F.col("median") / F.lit(US_PER_HOUR)).drop("median")
    return agg.join(med, keys, "inner")


def resolution_by_category(req: DataFrame, min_count: int = 10, exact: bool = True) -> DataFrame:
    """A-20: category, avg_hours, median_hours (2 dp), sample_size; >= min_count rows; avg desc.

    ``exact=False`` uses the one-pass ``percentile_approx`` median."""
    s = _stats(_valid(req, ["category"]), ["category"], exact).where(F.col("n") >= min_count)
    return s.select("category", rnd("avg_h", 2).alias("avg_hours"), rnd("med_h", 2).alias("median_hours"),
                    F.col("n").alias("sample_size")).transform(lambda d: sort_small(d, F.desc("avg_hours"), "category"))


def resolution_overall(req: DataFrame) -> DataFrame:
    """A-20 header: overall_avg_hours, overall_median_hours over all valid rows."""
    df = _valid(req, [])
    df = df.withColumn("_all", F.col("res_us").isNotNull())     # data-derived single key (see exact_median)
    s = _stats(df, ["_all"])
    return s.select(rnd("avg_h", 2).alias("overall_avg_hours"), rnd("med_h", 2).alias("overall_median_hours"),
                    F.col("n").alias("sample_size"))


def resolution_by_hour(req: DataFrame, min_count: int = 5) -> DataFrame:
    """A-21: hour opened, avg_hours (2 dp), count; hours with >= min_count rows."""
    df = filters.valid_resolution(req)
    return (df.groupBy(F.hour("opened").alias("hour"))
            .agg(rnd(F.avg("resolution_hours"), 2).alias("avg_hours"), F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= min_count).transform(lambda d: sort_small(d, "hour")))


def mean_vs_median(req: DataFrame) -> DataFrame:
    """A-36: category, avg_hours, median_hours, skew_ratio = avg / median (2 dp)."""
    s = _stats(_valid(req, ["category"]), ["category"])
    return s.select("category", rnd("avg_h", 2).alias("avg_hours"), rnd("med_h", 2).alias("median_hours"),
                    rnd(ratio("avg_h", "med_h"), 2).alias("skew_ratio"))


def sla_breach(req: DataFrame, threshold_hours: float = 72.0) -> DataFrame:
    """A-41: category, n, breached (> threshold), breach_share (% , 1 dp)."""
    df = filters.valid_resolution(req)
    out = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum((F.col("resolution_hours") > threshold_hours).cast("long")).alias("breached"))
    return out.withColumn("breach_share", pct("breached", "n", 1))

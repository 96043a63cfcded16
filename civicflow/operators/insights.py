"""Category insights: A-34 growth trend (first vs second half of the span)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct_change

GROWTH_BAND = 5.0   # |growth| <= 5 % is STABLE


def category_growth(req: DataFrame) -> DataFrame:
    """A-34: category, first_half, second_half, growth_pct (1 dp), trend.

    The split point is the midpoint of [min(opened), max(opened)] of the whole
    table, found by one scalar subquery.
    """
    us = F.unix_micros(F.col("opened").cast("timestamp"))
    mid = req.select(((F.min(us) + F.max(us)) / 2).cast("long")).scalar()     # one scalar subquery
    late = F.unix_micros(F.col("opened").cast("timestamp")) >= mid
    c = req.groupBy("category").agg(F.sum((~late).cast("long")).alias("first_half"),
                                    F.sum(late.cast("long")).alias("second_half"))
    g = pct_change(F.col("second_half"), F.col("first_half"), 1)
    return c.withColumn("growth_pct", g).withColumn(
        "trend", F.when(F.col("growth_pct") > GROWTH_BAND, "GROWING")
        .when(F.col("growth_pct") < -GROWTH_BAND, "DECLINING").otherwise("STABLE"))

"""District questions: A-19, A-35, A-37, A-38 (and J-05 name lookup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import sort_small
from ..functions.numeric import pct, rnd
from . import filters


def with_names(counts: DataFrame, districts: DataFrame) -> DataFrame:
    """J-05: attach the district name, 'District n' when unknown.

    The dimension has 11 rows by construction, so it is broadcast."""
    named = counts.join(F.broadcast(districts.withColumnRenamed("name", "_dname")), "district", "left")
    return named.withColumn("name", F.coalesce(F.col("_dname"), F.concat(F.lit("District "), F.col("district"))))\
        .drop("_dname")


def district_breakdown(req: DataFrame, districts: DataFrame) -> DataFrame:
    """A-19: district, name, count, percentage (2 dp of rows with a district); count desc."""
    df = req.where(F.col("district").isNotNull())
    c = df.groupBy("district").agg(F.count(F.lit(1)).alias("count"))
    c = c.withColumn("percentage", pct(F.col("count"), F.sum("count").over(Window.partitionBy()), 2))  # <= #districts
    return sort_small(with_names(c, districts).select("district", "name", "count", "percentage"),
                      F.desc("count"), "district")


def district_concentration(req: DataFrame) -> DataFrame:
    """A-35: per category the district holding the largest share: category, district, count, concentration (1 dp)."""
    df = req.where(F.col("district").isNotNull())
    c = df.groupBy("category", "district").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("category")
    c = c.withColumns({"concentration": pct(F.col("count"), F.sum("count").over(w), 1),
                       "rn": F.row_number().over(w.orderBy(F.desc("count"), "district"))})
    return c.where("rn = 1").drop("rn")


def district_cumulative_share(req: DataFrame) -> DataFrame:
    """A-37: district, count, rank, cum_share (% of rows with district, running, 2 dp)."""
    c = req.where(F.col("district").isNotNull()).groupBy("district").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy().orderBy(F.desc("count"), "district")    # <= #districts rows
    total = F.sum("count").over(Window.partitionBy())
    return c.select("district", "count", F.row_number().over(w).cast("long").alias("rank"),
                    pct(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)), total, 2).alias("cum_share"))


def district_risk(req: DataFrame) -> DataFrame:
    """A-38: district, count, avg_hours, score = percent_rank(count) + percent_rank(avg_hours) (4 dp)."""
    df = req.where(F.col("district").isNotNull())
    valid = filters.valid_resolution(df)
    vol = df.groupBy("district").agg(F.count(F.lit(1)).alias("count"))
    slow = valid.groupBy("district").agg(F.avg("resolution_hours").alias("avg_h"))
    j = vol.join(slow, "district", "inner")
    w = Window.partitionBy()
    score = F.percent_rank().over(w.orderBy("count")) + F.percent_rank().over(w.orderBy("avg_h"))
    return j.select("district", "count", rnd("avg_h", 2).alias("avg_hours"), rnd(score, 4).alias("score"))

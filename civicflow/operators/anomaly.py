"""W-04 anomaly detection and J-08 calendar densify.

Work is bounded before anything is expanded: the top-20 categories (a
TakeOrderedAndProject) and the last 37 days (a scalar subquery for the
latest day) define a grid of at most 20 x 37 rows, built by exploding a date
``sequence`` per category row -- a generator, not a join. Window statistics
then run per category over that grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ANOMALY_RECENT_DAYS, ANOMALY_TOP_CATEGORIES, ANOMALY_WINDOW_DAYS, ANOMALY_Z
from ..functions.ordering import sort_small
from ..functions.numeric import rnd


def densify(counts: DataFrame, keys: DataFrame, key: str, start, end, value: str = "count") -> DataFrame:
    """J-08: every (key, day) in [start, end] with ``value`` 0-filled.

    ``keys`` is a small, already-bounded key set; ``start``/``end`` are date
    columns or literals. Each key row generates its own calendar.
    """
    grid = keys.select(key, F.explode(F.sequence(F.lit(start) if not hasattr(start, "alias") else start,
                                                  F.lit(end) if not hasattr(end, "alias") else end)).alias("date"))
    return grid.join(counts.select(key, "date", value), [key, "date"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0)))


def anomalies(req: DataFrame, events_by_date: DataFrame | None = None,
              top: int = ANOMALY_TOP_CATEGORIES, recent_days: int = ANOMALY_RECENT_DAYS,
              window_days: int = ANOMALY_WINDOW_DAYS, z: float = ANOMALY_Z) -> DataFrame:
    """W-04: date, category, actual_count, expected_count, deviation_factor, possible_event_cause."""
    # one aggregate over the facts serves the latest day, the top categories and the history
    per_day = (req.where(F.col("opened").isNotNull()).groupBy("category", F.to_date("opened").alias("date"))
               .agg(F.count(F.lit(1)).alias("count")))
    max_date = per_day.select(F.max("date")).scalar()
    recent_start = F.date_sub(max_date, recent_days - 1)
    history_start = F.date_sub(recent_start, window_days)
    top_cats = (per_day.groupBy("category").agg(F.sum("count").alias("c"))
                .orderBy(F.desc("c"), "category").limit(top).select("category"))
    daily = (per_day.where(F.col("date") >= history_start)
             .join(F.broadcast(top_cats), "category", "left_semi"))       # <= top rows
    dense = densify(daily, top_cats, "category", history_start, max_date)
    # z from exact integer window sums: z = (n*x - S) / sqrt(n*Q - S^2) with
    # S = sum, Q = sum of squares. Counts are integers, so S, Q and the
    # numerator are exact; a textbook z of exactly 2.0 stays exactly 2.0.
    w = Window.partitionBy("category").orderBy("date").rowsBetween(-window_days, -1)
    stats = dense.withColumns({"s": F.sum("count").over(w), "q": F.sum(F.col("count") * F.col("count")).over(w),
                               "n": F.count(F.lit(1)).over(w)})
    spread = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    flagged = (stats.where((F.col("date") >= recent_start) & (F.col("n") >= 7) & (spread != 0))
               .withColumns({"avg": F.col("s") / F.col("n"),
                             "dev": (F.col("n") * F.col("count") - F.col("s")) / F.sqrt(spread.cast("double"))})
               .where(F.col("dev") > z))
    out = flagged.select("date", "category", F.col("count").cast("long").alias("actual_count"),
                         rnd("avg", 1).alias("expected_count"), rnd("dev", 2).alias("deviation_factor"))
    if events_by_date is not None:
        names = F.filter(F.split(F.col("event_names"), r"\|"), lambda x: F.trim(x) != "")
        label = F.when(F.size(names) > 0, F.concat(
            F.lit("Same-day events: "), F.array_join(F.slice(F.transform(names, lambda x: F.trim(x)), 1, 3), ", "),
            F.when(F.size(names) > 3, F.lit("...")).otherwise(F.lit(""))))
        ev = events_by_date.select("date", label.alias("possible_event_cause"))
        out = out.join(ev, "date", "left")
    else:
        out = out.withColumn("possible_event_cause", F.lit(None).cast("string"))
    return sort_small(out, F.desc("deviation_factor"), "date", "category")

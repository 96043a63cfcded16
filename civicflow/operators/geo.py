"""Map questions: A-28 points, A-29 grid heatmap, M-07 hotspots.

Top-k category sets are at most k rows (TakeOrderedAndProject), so joining
them back is a broadcast of a k-row table; point rows stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORY_COLORS
from ..functions.geo import in_box
from ..functions.numeric import rnd
from . import filters


def _ranked_top(counts: DataFrame, k: int) -> DataFrame:
    top = counts.orderBy(F.desc("n"), "category").limit(k)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "category"))   # <= k rows
    colors = F.array(*[F.lit(c) for c in CATEGORY_COLORS])
    return top.withColumn("rank", rank.cast("long")).withColumn("color", F.element_at(colors, F.col("rank").cast("int")))


def map_points(req: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None,
               district: int | None = None, k: int = 10) -> DataFrame:
    """A-28: category, rank, color, lat, lon for the top-k categories inside the open box."""
    df = filters.filter_district(filters.filter_category(filters.filter_date_range(req, start, end), category),
                                 district)
    df = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                  & in_box("latitude", "longitude", inclusive=False))
    top = _ranked_top(df.groupBy("category").agg(F.count(F.lit(1)).alias("n")), k)
    pts = df.join(F.broadcast(top.select("category", "rank", "color")), "category", "inner")   # k rows
    return pts.select("category", "rank", "color", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def map_category_totals(req: DataFrame, start: str | None = None, end: str | None = None,
                        category: str | None = None, district: int | None = None, k: int = 10) -> DataFrame:
    """A-28 summary: category, rank, color, count (points per category)."""
    pts = map_points(req, start, end, category, district, k)
    return pts.groupBy("category", "rank", "color").agg(F.count(F.lit(1)).alias("count"))


def map_heatmap(grid: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None,
                k: int = 10) -> DataFrame:
    """A-29: top-k categories by number of grid rows; cells with counts, per-category total, all-category total."""
    g = filters.filter_category(filters.filter_rollup_months(grid, start, end), category)
    per_cat = g.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("count").cast("long").alias("category_count"))
    every = F.sum("category_count").over(Window.partitionBy()).cast("long")     # one row per category
    top = _ranked_top(per_cat.withColumn("total_points", every), k)
    cells = g.join(F.broadcast(top.drop("n")), "category", "inner")             # k rows
    return cells.select("category", "rank", "color", "lat_cell", "lon_cell", "year_month", "count",
                        "category_count", "total_points")


def hotspots(grid: DataFrame, start: str | None = None, end: str | None = None, top_n: int = 10,
             per_cell: int = 3) -> DataFrame:
    """M-07: the top_n grid cells by volume with their top categories.

    Cell totals are a partial aggregate; the top categories per cell use a
    row_number limit (map-side WindowGroupLimit) on (cell, category) counts.
    """
    g = filters.filter_rollup_months(grid, start, end)
    by_cat = g.groupBy("lat_id", "lon_id", "lat_cell", "lon_cell", "category").agg(F.sum("count").alias("n"))
    cells = (by_cat.groupBy("lat_id", "lon_id", "lat_cell", "lon_cell").agg(F.sum("n").cast("long").alias("volume"))
             .orderBy(F.desc("volume"), "lat_id", "lon_id").limit(top_n))
    rn = F.row_number().over(Window.partitionBy("lat_id", "lon_id").orderBy(F.desc("n"), "category"))
    # only the chosen cells' categories are ranked (at most top_n cells)
    own = by_cat.join(F.broadcast(cells.select("lat_id", "lon_id")), ["lat_id", "lon_id"], "left_semi")
    tops = own.withColumn("rn", rn).where(F.col("rn") <= per_cell)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "category"))), lambda x: x["category"])
    top_cats = tops.groupBy("lat_id", "lon_id").agg(F.array_join(names, "|").alias("top_categories"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("volume"), "lat_id", "lon_id"))  # top_n rows
    return (cells.join(top_cats, ["lat_id", "lon_id"], "inner")
            .select(rank.cast("long").alias("rank"), "lat_cell", "lon_cell", F.col("volume").alias("predicted_volume"),
                    "top_categories"))


def neighbourhood_hotspots(grid: DataFrame, start: str | None = None, end: str | None = None, reach: int = 1) -> DataFrame:
    """M-07 by neighbourhood: per grid cell the local statistic of its volume together with that of the cells up
    to ``reach`` steps away, as a z-score (4 dp) against an even spread over the cells that have requests.

    Each cell sends its volume to the (2 * reach + 1)^2 cells around it and every cell adds up what reaches it, so the
    work is linear in the cells; no pair of cells is ever compared. The score is null where all cells have the same
    volume or all of them are neighbours."""
    cells = (filters.filter_rollup_months(grid, start, end).groupBy("lat_id", "lon_id")
             .agg(F.sum("count").cast("long").alias("volume")))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = cells.withColumn("up", F.explode(steps)).withColumn("right", F.explode(steps)).groupBy(
        (F.col("lat_id") + F.col("up")).alias("lat_id"), (F.col("lon_id") + F.col("right")).alias("lon_id")).agg(
        F.sum("volume").alias("around"), F.count(F.lit(1)).alias("cells"))
    whole = cells.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.sum("volume").cast("double").alias("s"),
                               F.sum(F.col("volume") * F.col("volume")).cast("double").alias("q")).alias("t")).scalar()
    own = cells.join(sent, ["lat_id", "lon_id"]).withColumn("t", whole)
    n, s, q, w = F.col("t.n"), F.col("t.s"), F.col("t.q"), F.col("cells").cast("double")
    spread = F.sqrt(F.greatest(n * q - s * s, F.lit(0.0))) / n * F.sqrt(F.try_divide(n * w - w * w, n - 1))
    return own.select("lat_id", "lon_id", "volume", "around", "cells",
                      rnd(F.try_divide(F.col("around") - s / n * w, spread), 4).alias("z"))

"""Sinks and batch jobs: S-06 .. S-12, plus the rollup build job (E2).

Writers are plain ``DataFrameWriter`` calls. Output paths are whatever the
caller passes (on a cluster: shared storage); nothing here uses a
machine-local folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters, normalize, rollups
from ..session import Scratch


MOST_REFRESH_DAYS = 31


class NoRowsInRange(LookupError):
    """S-07: the requested slice is empty (the HTTP layer maps it to 404)."""


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  compression: str = "gzip", mode: str = "overwrite") -> None:
    """S-06: compressed Parquet, optionally partitioned."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(req: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """S-07: CSV (with header) of a date slice; raises NoRowsInRange if empty."""
    df = filters.filter_date_range(req, start, end) if (start or end) else req
    if df.isEmpty():            # one limit-1 probe, not a count
        raise NoRowsInRange(f"nothing to export from {start or 'the first day'} to {end or 'the last'}")
    # CSV has no nested values: they are written as JSON text
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def clustered(df: DataFrame, date_col: str, cluster_by: list[str]) -> DataFrame:
    """S-09: rows grouped by day partition and sorted by the cluster keys
    inside each file, so row-group statistics prune on the cluster keys.

    ``REBALANCE`` (not ``repartition``) lets AQE split a hot day into several
    evenly sized tasks/files and merge small days, so a day holding a third of
    all rows never lands in one task."""
    return df.hint("rebalance", date_col).sortWithinPartitions(date_col, *cluster_by)


def warehouse_append(df: DataFrame, path: str, cluster_by: tuple[str, ...] = ("category",)) -> None:
    """S-08: append the load projection, day-partitioned on ``opened`` and
    clustered; new columns are allowed (read back with ``mergeSchema``)."""
    proj = normalize.load_projection(df).withColumn("opened_date", F.to_date("opened"))
    keys = [c for c in cluster_by if c in proj.columns]
    clustered(proj, "opened_date", keys).write.mode("append").partitionBy("opened_date").parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """M-08 / S-09: predictions table partitioned by ``prediction_date`` and
    clustered by model and category inside each day."""
    (clustered(predictions, "prediction_date", ["model_used", "category"])
     .write.mode(mode).partitionBy("prediction_date").parquet(path))


def read_warehouse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def refresh_partitions(df: DataFrame, path: str, date_col: str = "date", compression: str = "gzip") -> None:
    """S-10: incremental refresh -- overwrite only the day partitions present
    in ``df`` (dynamic partition overwrite); older days are kept."""
    (df.hint("rebalance", date_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", compression).partitionBy(date_col).parquet(path))


def refresh_recent(df: DataFrame, path: str, as_of, days: int = 31, date_col: str = "date") -> None:
    """S-10 flag: re-land only the last ``days`` days (1 to 31) before ``as_of`` and
    overwrite just those day partitions; history stays."""
    import datetime as _dt
    if not 1 <= int(days) <= MOST_REFRESH_DAYS:
        raise ValueError(f"days must be between 1 and {MOST_REFRESH_DAYS}")
    since = as_of - _dt.timedelta(days=days)
    refresh_partitions(df.where(F.col(date_col) >= F.lit(since)), path, date_col)


def rollup_metadata(tables: dict[str, DataFrame], daily: DataFrame, recent_days: int = 90) -> DataFrame:
    """S-11: one row per rollup (name, rows) plus the date range and the number of request
    rows covered (from the daily rollup), and the day from which recent rows are kept."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("rollup"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    span = daily.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                     F.sum("count").cast("long").alias("record_count"))
    return out.select("rollup", "rows",
                      span.select("start_date").scalar().alias("start_date"),
                      span.select("end_date").scalar().alias("end_date"),
                      span.select("record_count").scalar().alias("record_count"),
                      F.date_sub(span.select("end_date").scalar(), recent_days).alias("recent_cutoff"))


def validation_report(tables: dict[str, DataFrame], date_col: str = "date") -> DataFrame:
    """S-12: per table: rows, null dates, min/max date, ok (= rows > 0 and the
    date column present). One aggregate per table, no row leaves the executors."""
    parts = []
    for name, df in tables.items():
        if date_col in df.columns:
            d = F.col(date_col)
            agg = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(d.isNull().cast("long")).alias("null_dates"),
                         F.min(d).cast("date").alias("min_date"), F.max(d).cast("date").alias("max_date"))
            parts.append(agg.select(F.lit(name).alias("table"), "rows",
                                    F.coalesce("null_dates", F.lit(0).cast("long")).alias("null_dates"),
                                    "min_date", "max_date", (F.col("rows") > 0).alias("ok")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(None).cast("long").alias("null_dates"),
                F.lit(None).cast("date").alias("min_date"), F.lit(None).cast("date").alias("max_date"),
                F.lit(False).alias("ok")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------ S-11 / S-12 from the writes themselves
def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], **options) -> dict:
    """Write ``df`` (see ``write_parquet``) and return ``metrics`` over the rows written: they are aggregated
    while the rows pass, so nothing is read a second time."""
    seen = Observation(f"write of {path}")
    write_parquet(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path, **options)
    return seen.get


def table_metrics(df: DataFrame, date_col: str = "date") -> dict[str, Column]:
    """Rows and, where there is a date column, null dates and the first and last date."""
    out = {"rows": F.count(F.lit(1))}
    if date_col in df.columns:
        d = F.col(date_col)
        out |= {"null_dates": F.count_if(d.isNull()), "min_date": F.min(d).cast("date"), "max_date": F.max(d).cast("date")}
    return out


def write_with_report(tables: dict[str, DataFrame], folder: str, date_col: str = "date") -> DataFrame:
    """S-12 while writing: every table goes to ``folder/<name>.parquet``; the validation report (one row
    per table) comes from the writes."""
    rows = []
    for name, df in tables.items():
        seen = write_observed(df, f"{folder}/{name}.parquet", table_metrics(df, date_col))
        dated = date_col in df.columns
        rows.append((name, seen["rows"], seen.get("null_dates"), seen.get("min_date"), seen.get("max_date"), dated and seen["rows"] > 0))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, rows long, null_dates long, min_date date, max_date date, ok boolean")


def write_with_metadata(tables: dict[str, DataFrame], folder: str, recent_days: int = 90) -> DataFrame:
    """S-11 while writing: every rollup goes to ``folder/<name>.parquet``; the metadata rows come from the writes,
    date range and number of requests from that of ``daily_agg``."""
    rows, span = [], {}
    for name, df in tables.items():
        metrics = {"rows": F.count(F.lit(1))}
        if name == "daily_agg":
            metrics |= {"start_date": F.min("date"), "end_date": F.max("date"), "record_count": F.sum("count").cast("long")}
        seen = write_observed(df, f"{folder}/{name}.parquet", metrics)
        rows.append((name, seen["rows"]))
        span |= {k: seen[k] for k in ("start_date", "end_date", "record_count") if k in seen}
    spark = next(iter(tables.values())).sparkSession
    last = span.get("end_date")
    cutoff = last - dt.timedelta(days=recent_days) if last else None
    return spark.createDataFrame([(*r, span.get("start_date"), last, span.get("record_count"), cutoff) for r in rows],
                                 "rollup string, rows long, start_date date, end_date date, record_count long, recent_cutoff date")


def build_rollups(spark: SparkSession, raw: DataFrame, out_dir: str, recent_days: int = 90) -> dict[str, str]:
    """E2: normalise once, write the clean table (this cuts lineage: the
    rollups re-read a written table, so a lost executor never recomputes the
    cleaning), then write every rollup as gzip Parquet plus metadata JSON."""
    clean_path = f"{out_dir}/requests_clean"
    clean = normalize.normalize_requests(raw).withColumn("opened_date", F.to_date("opened"))
    (clustered(clean, "opened_date", ["category"])
     .write.mode("overwrite").option("compression", "gzip").partitionBy("opened_date").parquet(clean_path))
    req = spark.read.parquet(clean_path)
    paths = {"requests_clean": clean_path}
    with Scratch(spark) as scratch:
        cube = scratch.write(rollups.hour_cube(req))       # one scan for all rollups of the calendar
        tables = {name: rollups.OF_CUBE[name](cube) if name in rollups.OF_CUBE else
                  fn(req, recent_days) if name == "recent_raw" else fn(req) for name, fn in rollups.ROLLUPS.items()}
        meta = write_with_metadata(tables, out_dir, recent_days)
        write_parquet(rollups.daily_aggregates_of_cube(cube), f"{out_dir}/daily_aggregates.parquet")
    paths |= {name: f"{out_dir}/{name}.parquet" for name in (*rollups.ROLLUPS, "daily_aggregates")}
    meta.repartition(1).write.mode("overwrite").json(f"{out_dir}/metadata.json")
    paths["metadata"] = f"{out_dir}/metadata.json"
    return paths


def build_side_tables(spark: SparkSession, out_dir: str, events: DataFrame | None, closures: DataFrame | None,
                      permits: DataFrame | None, crime: DataFrame | None, weather: DataFrame | None) -> dict[str, str]:
    """Side-table rollups next to the request rollups: events_agg, events_by_date,
    crime_agg, weather_agg (each one row per day or per day x district)."""
    from ..operators import events as ev
    tables = {}
    if events is not None or closures is not None or permits is not None:
        tables["events_agg"] = ev.events_agg(events, closures, permits)
        tables["events_by_date"] = ev.events_by_date(events, closures, permits)
    if crime is not None:
        tables["crime_agg"] = ev.crime_agg(crime)
    if weather is not None:
        tables["weather_agg"] = weather
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir}/{name}.parquet"
        write_parquet(df, path)
        paths[name] = path
    return paths

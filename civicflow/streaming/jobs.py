"""Structured Streaming jobs and their batch twins: T-01 .. T-06.

Each metric is one function usable on a batch DataFrame *and* on a streaming
one (same code, so the batch twin is the correctness oracle for the stream).
Stream jobs use event-time watermarks, append output of finalised windows,
and keep checkpoints under the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster), so a restarted or re-scheduled job resumes exactly once.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import ts_lit
from ..functions.numeric import rnd
from ..operators.selection import exact_percentiles
from ..session import Scratch, checkpoint_dir, materialize

ERROR_RATE_THRESHOLD = 0.05     # alert when > 5 % of requests in a window are errors
SUSTAINED_WINDOWS = 5           # ... for 5 consecutive 60 s windows (300 s)
LATENCY_GOOD_MS = 1000.0        # SLO: request served under 1 s
SLO_DAYS = 30


# ---------------------------------------------------------------- sources
def event_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of landed Parquet; event time cast to TIMESTAMP for watermarks."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def monitoring_rows(events: DataFrame) -> DataFrame:
    """Serving log view of ``events``: ts, is_error, latency_ms."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"),
                         (F.col("event_type") == "error").alias("is_error"),
                         F.col("value").alias("latency_ms"))


# ---------------------------------------------------------------- T-01
def daily_windows(req: DataFrame, ts: str = "opened") -> DataFrame:
    """T-01 aggregation: (day, category, district) -> count, resolution sum/count.

    Sum and count (not the mean) are kept so late rows merge exactly."""
    return (req.groupBy(F.window(F.col(ts), "1 day").alias("w"), "category", "district")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("resolution_hours").alias("resolution_sum"),
                 F.count("resolution_hours").alias("resolution_n"))
            .select(F.to_date(F.col("w.start")).alias("date"), "category", "district", "count",
                    "resolution_sum", "resolution_n"))


def start_daily_rollup(stream: DataFrame, out_path: str, name: str = "daily_rollup",
                       watermark: str = "2 days", available_now: bool = True) -> StreamingQuery:
    """T-01 stream: watermark + 1-day windows, append finalised days to a
    date-partitioned Parquet table (exactly-once via the file sink log)."""
    spark = stream.sparkSession
    agg = daily_windows(stream.withColumn("opened", F.col("opened").cast("timestamp"))
                        .withWatermark("opened", watermark))
    w = (agg.writeStream.outputMode("append").format("parquet").partitionBy("date")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_path)


DAILY_KEYS = ["date", "category", "district"]


def merge_daily_batch(batch: DataFrame, table_path: str) -> None:
    """Upsert one micro-batch of updated day groups into the date-partitioned table.

    In ``update`` mode each row carries the *current total* of its group, so
    the merge is: existing rows of the touched days minus the updated keys,
    plus the updated rows; only those day partitions are rewritten (dynamic
    overwrite). Re-running an epoch after a failure rewrites the same values.
    """
    with Scratch(batch.sparkSession) as scratch:        # both tables go when the merge is written
        _merge_daily(scratch.write(batch), table_path, scratch)


def _merge_daily(batch: DataFrame, table_path: str, scratch: Scratch) -> None:
    spark = batch.sparkSession                  # the batch is computed once, read by every step below
    if batch.isEmpty():
        return
    days = batch.select("date").distinct()      # days touched (inside the watermark span)
    try:
        table = spark.read.parquet(table_path)
    except AnalysisException as e:
        # no table yet; any other failure to read it must not look like an empty one
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        merged = batch
    else:
        # semi join on the partition column: dynamic partition pruning reads only touched days
        existing = table.join(days, "date", "left_semi")
        merged = (existing.join(batch, [existing[k].eqNullSafe(batch[k]) for k in DAILY_KEYS], "left_anti")
                  .unionByName(batch.select(*existing.columns)))
        merged = scratch.write(merged)          # cut the read of the partitions about to be overwritten
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date")
     .parquet(table_path))


def start_daily_rollup_upsert(stream: DataFrame, table_path: str, name: str = "daily_rollup_upsert",
                              watermark: str = "2 days", available_now: bool = True) -> StreamingQuery:
    """T-01 with late data: ``update`` output (a day's totals appear at once and
    are corrected as late rows arrive, until the watermark closes the day)
    merged into the table by ``foreachBatch``."""
    spark = stream.sparkSession
    agg = daily_windows(stream.withColumn("opened", F.col("opened").cast("timestamp"))
                        .withWatermark("opened", watermark))
    w = (agg.writeStream.outputMode("update")
         .foreachBatch(lambda df, epoch: merge_daily_batch(df, table_path))
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# ---------------------------------------------------------------- T-02 / T-03
def window_metrics(rows: DataFrame, width: str = "60 seconds") -> DataFrame:
    """T-02 / T-03: per window: requests, errors, error_rate (4 dp), mean latency (2 dp)."""
    return (rows.groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("is_error").cast("long")).alias("errors"),
                 F.avg("latency_ms").alias("lat"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "errors",
                    rnd(F.col("errors") / F.col("requests"), 4).alias("error_rate"),
                    rnd("lat", 2).alias("mean_latency_ms")))


METRICS_SCHEMA = ("window_start timestamp_ntz, requests long, errors long, error_rate double, "
                  "mean_latency_ms double")


def start_window_metrics(rows_stream: DataFrame, out_path: str, width: str = "60 seconds",
                         watermark: str = "2 minutes", name: str = "window_metrics",
                         available_now: bool = True) -> StreamingQuery:
    """T-02 / T-03 stream, job 1: finalised window metrics appended to a table
    (watermark bounds the open-window state)."""
    spark = rows_stream.sparkSession
    m = window_metrics(rows_stream.withWatermark("ts", watermark), width)
    w = (m.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_path)


def latency_percentiles(rows: DataFrame, width: str = "60 seconds") -> DataFrame:
    """T-03: exact nearest-rank P50 / P95 / P99 latency per window (ms, 2 dp).

    Latency is scaled to integer hundredths for the skew-safe radix selection."""
    r = rows.select(F.window("ts", width).start.cast("timestamp_ntz").alias("window_start"),
                    F.round(F.col("latency_ms") * 100).cast("long").alias("lat_c"))
    p = exact_percentiles(materialize(r), ["window_start"], "lat_c", [0.5, 0.95, 0.99])
    return p.select("window_start", *[(F.col(c) / F.lit(100.0)).alias(f"{c}_ms") for c in ("p50", "p95", "p99")])


SKETCH_K = 400


def sketch_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of a quantile sketch of size ``k`` at 99 % confidence (fixed values of the
    sketch family); about 0.7 % at 400. Windows of at most ``k`` rows are exact."""
    return 2.296 / k ** 0.9723


def latency_sketches(rows: DataFrame, width: str = "60 seconds", k: int = SKETCH_K) -> DataFrame:
    """T-03 as a stream can keep it: per window the number of latencies and a mergeable quantile sketch of
    them. A window's state is one sketch of bounded size, however many requests it has."""
    known = rows.where(F.col("latency_ms").isNotNull())
    return (known.groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "sketch"))


def merged_sketches(sketches: DataFrame, width: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of wider windows from those of narrower ones, without the rows."""
    wide = F.window(F.col("window_start"), width).alias("w")
    return (sketches.groupBy(wide).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "sketch"))


def sketch_percentiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``window_start, requests, p50_ms, ...``: the rank of each value in its window lies within ``sketch_error`` of the asked one."""
    return sketches.select("window_start", "requests", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(f"p{round(100 * r)}_ms") for r in ranks])


def ranks_within(rows: DataFrame, percentiles: DataFrame, width: str, error: float,
                 ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Audit of ``sketch_percentiles`` against the rows: per window whether the share of rows below each value
    and of rows not above it enclose the asked rank up to ``error``."""
    own = rows.where(F.col("latency_ms").isNotNull()).select(
        F.window("ts", width).start.cast("timestamp_ntz").alias("window_start"), "latency_ms")
    names = [f"p{round(100 * r)}_ms" for r in ranks]
    both = own.join(percentiles, "window_start").groupBy("window_start").agg(
        F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("latency_ms") < F.col(n)).alias(f"{n}_below") for n in names],
        *[F.count_if(F.col("latency_ms") <= F.col(n)).alias(f"{n}_upto") for n in names])
    return both.select("window_start", "requests", *[
        ((F.col(f"{n}_below") <= (r + error) * F.col("requests")) & (F.col(f"{n}_upto") >= (r - error) * F.col("requests")))
        .alias(n.replace("_ms", "_within")) for n, r in zip(names, ranks)])


def start_latency_sketches(rows_stream: DataFrame, out_path: str, width: str = "60 seconds", watermark: str = "2 minutes",
                           name: str = "latency_sketches", available_now: bool = True, k: int = SKETCH_K) -> StreamingQuery:
    """T-03 stream: finalised windows' sketches appended to a table, from which ``sketch_percentiles`` answers
    and ``merged_sketches`` makes hours and days."""
    spark = rows_stream.sparkSession
    m = latency_sketches(rows_stream.withWatermark("ts", watermark), width, k)
    w = (m.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_path)


def sustained_alerts(metrics: DataFrame, threshold: float = ERROR_RATE_THRESHOLD,
                     min_windows: int = SUSTAINED_WINDOWS, width_s: int = 60, keys: list[str] | None = None,
                     rate_col: str = "error_rate") -> DataFrame:
    """T-02: runs of >= ``min_windows`` consecutive windows above ``threshold``.

    Gaps-and-islands on window rows: consecutive breaching windows share
    ``window_number - row_number``. Works on windowed metrics (one row per
    window), so its size is bounded by the time span, not the request volume.
    """
    keys = keys or []
    hot = metrics.where(F.col(rate_col) > threshold).withColumn(
        "wn", (F.unix_micros(F.col("window_start").cast("timestamp")) / F.lit(width_s * 1_000_000)).cast("long"))
    w = Window.partitionBy(*keys).orderBy("wn")
    isl = hot.withColumn("island", F.col("wn") - F.row_number().over(w))
    runs = isl.groupBy(*keys, "island").agg(F.min("window_start").alias("alert_start"),
                                             F.max("window_start").alias("last_window"),
                                             F.count(F.lit(1)).alias("windows"),
                                             F.max(rate_col).alias("peak_rate"))
    return runs.where(F.col("windows") >= min_windows).drop("island")


ALERT_STATE = "run LONG, last_wn LONG, start_wn LONG, fired BOOLEAN"
ALERT_OUT = "key STRING, alert_start_wn LONG, windows LONG"


def _alert_fn(key, pdfs, state: GroupState):
    """Custom stateful operator: carry the current run of breaching windows per key.

    A key's rows of one micro-batch come in several chunks in no order; they are
    window numbers (finalised windows, one row each), gathered and sorted once.
    Windows at or before the last one seen are late and ignored."""
    run, last, start, fired = state.get if state.exists else (0, -2, -1, False)
    out = []
    for wn in sorted({int(w) for pdf in pdfs for w in pdf["wn"]}):
        if wn <= last:
            continue
        if wn == last + 1:
            run += 1
        else:
            run, start, fired = 1, wn, False
        last = wn
        if run >= SUSTAINED_WINDOWS and not fired:
            out.append((key[0], start, run))
            fired = True
    state.update((run, last, start, fired))
    yield pd.DataFrame(out, columns=["key", "alert_start_wn", "windows"])


def alert_stream(metrics_stream: DataFrame, threshold: float = ERROR_RATE_THRESHOLD, key: str | None = None,
                 width_s: int = 60) -> DataFrame:
    """T-02 stream, job 2: reads the finalised window table written by
    ``start_window_metrics`` and runs ``applyInPandasWithState`` keyed by
    ``key``. State is one run counter per key, so it stays small however many
    rows arrive; finalised windows arrive in event-time order."""
    hot = metrics_stream.where(F.col("error_rate") > threshold).select(
        (F.lit("all") if key is None else F.col(key).cast("string")).alias("key"),
        (F.unix_micros(F.col("window_start").cast("timestamp")) / F.lit(width_s * 1_000_000)).cast("long").alias("wn"))
    return hot.groupBy("key").applyInPandasWithState(_alert_fn, ALERT_OUT, ALERT_STATE, "append",
                                                     GroupStateTimeout.NoTimeout)


class AlertRuns(StatefulProcessor):
    """T-02 with late windows: the breaching windows of a key wait in a map until the watermark has passed the end of
    the window after a run's last; then no window can join the run any more and it is emitted, if long enough.
    State holds the windows of the open runs only, which the watermark bounds."""

    def __init__(self, min_windows: int, width_ms: int):
        self.min_windows, self.width_ms = min_windows, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("windows", "wn LONG", "rate DOUBLE")

    def handleInputRows(self, key, rows, timerValues):
        ends = set()
        for pdf in rows:
            for wn, rate in zip(pdf["wn"], pdf["error_rate"]):
                self.open.updateValue((int(wn),), (float(rate),))
                ends.add((int(wn) + 2) * self.width_ms)
        for end in ends:                               # when the next window is over
            self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        over = timerValues.getCurrentWatermarkInMs()
        rates = {int(k[0]): float(v[0]) for k, v in self.open.iterator()}
        run: list[int] = []
        out = []
        for wn in [*sorted(rates), None]:
            if run and wn != run[-1] + 1:
                if (run[-1] + 2) * self.width_ms <= over:
                    if len(run) >= self.min_windows:
                        out.append((key[0], run[0], run[-1], len(run), max(rates[w] for w in run)))
                    for w in run:
                        self.open.removeKey((w,))
                run = []
            run.append(wn)
        yield pd.DataFrame(out, columns=["key", "first_wn", "last_wn", "windows", "peak_rate"])


def alert_runs(metrics_stream: DataFrame, threshold: float = ERROR_RATE_THRESHOLD, min_windows: int = SUSTAINED_WINDOWS,
               width_s: int = 60, watermark: str = "10 minutes", key: str | None = None) -> DataFrame:
    """T-02 stream on event-time timers: ``key, alert_start, last_window, windows, peak_rate``, the columns of
    ``sustained_alerts``, whatever the order in which windows arrive inside the ``watermark``. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``)."""
    at = F.col("window_start").cast("timestamp")
    hot = metrics_stream.where(F.col("error_rate") > threshold).select(
        (F.lit("all") if key is None else F.col(key).cast("string")).alias("key"), at.alias("at"), "error_rate",
        (F.unix_micros(at) / F.lit(width_s * 1_000_000)).cast("long").alias("wn")).withWatermark("at", watermark)
    runs = hot.groupBy("key").transformWithStateInPandas(
        AlertRuns(min_windows, width_s * 1000), "key string, first_wn long, last_wn long, windows long, peak_rate double", "append", "EventTime")
    start = [F.timestamp_seconds(F.col(c) * width_s).cast("timestamp_ntz") for c in ("first_wn", "last_wn")]
    return runs.select("key", start[0].alias("alert_start"), start[1].alias("last_window"), "windows", "peak_rate")


# ---------------------------------------------------------------- T-04 / T-05 / T-06
def rolling_slo(rows: DataFrame, good_ms: float = LATENCY_GOOD_MS, days: int = SLO_DAYS) -> DataFrame:
    """T-04: per day, rolling ``days``-day share of requests under ``good_ms`` and
    of non-error requests (calendar range frame on the daily rows, 4 dp)."""
    d = rows.groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("total"), F.sum((F.col("latency_ms") < good_ms).cast("long")).alias("good"),
        F.sum((~F.col("is_error")).cast("long")).alias("ok"))
    w = Window.orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)   # one row per day
    return d.select("date", "total", "good",
                    rnd(F.sum("good").over(w) / F.sum("total").over(w), 4).alias("latency_slo"),
                    rnd(F.sum("ok").over(w) / F.sum("total").over(w), 4).alias("availability"))


def freshness_gauge(tables: dict[str, DataFrame], as_of: dt.datetime, ts_col: str = "ts") -> DataFrame:
    """T-05: dataset, last_ts, seconds_since (at ``as_of``)."""
    parts = [df.agg(F.max(F.col(ts_col).cast("timestamp_ntz")).alias("last_ts")).select(
        F.lit(name).alias("dataset"), "last_ts") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seconds_since",
                          F.timestamp_diff("SECOND", F.col("last_ts"), ts_lit(as_of)))


def labelled_counters(predictions: DataFrame) -> DataFrame:
    """T-06: predictions served by category x model: count and summed volume."""
    return predictions.groupBy("category", "model_used").agg(
        F.count(F.lit(1)).alias("predictions"), F.sum("predicted_volume").cast("long").alias("predicted_volume"))

"""Streaming jobs equal their batch twins on the same landed rows."""

import os

from pyspark.sql import functions as F

from civicflow.sources import fixtures
from civicflow.sources.tables import read_table
from civicflow.streaming import jobs
from fixture_tables import SMALL


def _events_stream(spark):
    schema = read_table(spark, SMALL, "events").schema
    return jobs.event_stream(spark, SMALL, schema, file_glob="events.parquet")


def test_daily_rollup_stream_matches_batch(spark, scratch):
    stream_req = fixtures.requests_from_events(_events_stream(spark))
    out = os.path.join(scratch, "daily")
    q = jobs.start_daily_rollup(stream_req, out, name="t01_test", watermark="0 seconds")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = jobs.daily_windows(fixtures.requests_short(spark, SMALL))
    cols = ["date", "category", "district", "count", "resolution_n"]
    # with availableNow the final (latest) day stays open under the watermark; all earlier days are final
    last = want.agg(F.max("date")).first()[0]
    a = sorted((tuple(r) for r in got.select(*cols).where(F.col("date") < last).collect()), key=repr)
    b = sorted((tuple(r) for r in want.select(*cols).where(F.col("date") < last).collect()), key=repr)
    assert a == b and len(a) > 0


def test_stateful_alert_stream_matches_batch(spark, scratch):
    rows = jobs.monitoring_rows(read_table(spark, SMALL, "events"))
    metrics = jobs.window_metrics(rows, "1 hour")
    batch = jobs.sustained_alerts(metrics, threshold=0.25, min_windows=jobs.SUSTAINED_WINDOWS, width_s=3600)
    # the last window stays open under the watermark, so a run of exactly five that ends there is not final yet
    last = metrics.agg(F.max("window_start")).first()[0]
    hour = 3_600_000_000
    want = {int(r["wn"]) for r in batch.where(~((F.col("windows") == jobs.SUSTAINED_WINDOWS) & (F.col("last_window") == F.lit(last))))
            .select((F.unix_micros(F.col("alert_start").cast("timestamp")) / hour).cast("long").alias("wn")).collect()}
    assert want
    # job 1: finalised hourly metrics to a table; job 2: stateful alerts over that table
    mpath = os.path.join(scratch, "metrics")
    jobs.start_window_metrics(jobs.monitoring_rows(_events_stream(spark)), mpath, "1 hour", "0 seconds",
                              name="metrics_test").awaitTermination(300)
    mstream = spark.readStream.schema(jobs.METRICS_SCHEMA).parquet(mpath)
    alerts = jobs.alert_stream(mstream, threshold=0.25, width_s=3600)
    q = (alerts.writeStream.outputMode("append").format("memory").queryName("alerts_test")
         .option("checkpointLocation", os.path.join(spark.conf.get("spark.checkpoint.dir"), "alerts_test"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM alerts_test").collect()
    assert {r["alert_start_wn"] for r in got} == want and len(got) == len(want)
    assert all(r["windows"] == jobs.SUSTAINED_WINDOWS for r in got)


class _State:
    """The part of GroupState that the alert function uses."""
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def _alerts(*batches):
    import pandas as pd
    state, out = _State(), []
    for chunks in batches:
        for df in jobs._alert_fn(("k",), iter([pd.DataFrame({"wn": c}) for c in chunks]), state):
            out += df.values.tolist()
    return out


def test_alert_does_not_depend_on_chunks():
    assert _alerts([[1, 2, 3, 4, 5, 6]]) == _alerts([[1, 3, 5], [2, 4, 6]]) == _alerts([[6], [5, 1], [4, 2, 3]]) == [["k", 1, 5]]
    # late and repeated windows leave the run as it is
    assert _alerts([[1, 2, 3]], [[2, 1]], [[4, 5]]) == [["k", 1, 5]]
    assert _alerts([[1, 2, 3]], [[5, 6, 7, 8]]) == []


def test_upsert_does_not_take_a_read_error_for_an_empty_table(spark, scratch, monkeypatch):
    import pytest
    from pyspark.errors import AnalysisException
    batch = spark.createDataFrame([("2024-01-01", "a", 1, 5, 1.0, 1)],
                                  "date string, category string, district int, count long, resolution_sum double, resolution_n long")
    path = os.path.join(scratch, "table")
    jobs.merge_daily_batch(batch, path)                       # no table yet: written
    jobs.merge_daily_batch(batch.withColumn("category", F.lit("b")), path)
    assert spark.read.parquet(path).count() == 2
    reader = type(spark.read)
    real = reader.parquet

    def broken(self, *paths, **kw):
        if paths == (path,):
            raise AnalysisException("the listing failed", errorClass=None)
        return real(self, *paths, **kw)

    monkeypatch.setattr(reader, "parquet", broken)
    with pytest.raises(AnalysisException):
        jobs.merge_daily_batch(batch, path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 2


def test_negative_latencies_count(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", v) for v in (-50.0, -1.25, 0.0, 3.0, 10.0)], "ts string, latency_ms double")
    got = jobs.latency_percentiles(rows.withColumn("ts", F.col("ts").cast("timestamp"))).first()
    assert (got["p50_ms"], got["p95_ms"]) == (0.0, 10.0)


def test_daily_rollup_upsert_stream_matches_batch(spark, scratch):
    """update mode + foreachBatch merge over 4 micro-batches that each touch every day."""
    events = read_table(spark, SMALL, "events")
    landed = os.path.join(scratch, "landed")
    events.repartition(4, (F.col("event_id") % 4)).write.parquet(landed)     # 4 files, each spans all days
    stream_req = fixtures.requests_from_events(
        jobs.event_stream(spark, landed, events.schema, max_files_per_trigger=1))
    out = os.path.join(scratch, "daily_upsert")
    q = jobs.start_daily_rollup_upsert(stream_req, out, name="t01_upsert_test", watermark="40 days")
    q.awaitTermination(300)
    assert q.lastProgress is not None
    cols = ["date", "category", "district", "count", "resolution_n"]
    got = sorted((tuple(r) for r in spark.read.parquet(out).select(*cols).collect()), key=repr)
    want = sorted((tuple(r) for r in jobs.daily_windows(fixtures.requests_short(spark, SMALL)).select(*cols)
                   .collect()), key=repr)
    assert got == want

"""Ranges cut into months, days and edges; the regression with a yearly season; rolling origins; one-scan rollups;
numbered copies; quantile sketches as a stream."""

import datetime as dt
import os
import random
from collections import Counter

import numpy as np
import pytest
from civicflow import session
from civicflow.operators import forecast, normalize, rollups, seasonal
from civicflow.plans import ranges
from civicflow.sources import fixtures
from civicflow.sources.tables import read_table
from civicflow.streaming import jobs
from fixture_tables import SMALL
from pyspark.sql import functions as F


def covered(parts):
    """All minutes of the parts, each as often as it is covered."""
    spans = [(a, b) for a, b in parts.edges]
    midnight = lambda d: dt.datetime.combine(d, dt.time())                                   # noqa: E731
    spans += [(midnight(a), midnight(b) + dt.timedelta(days=1)) for a, b in parts.days]
    if parts.months:
        spans.append((midnight(parts.months[0]), midnight(ranges._next_month(parts.months[1]))))
    return sorted(spans)


def test_parts_tile_the_range():
    rng = random.Random(1)
    for _ in range(3000):
        low = dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 400))
        high = low + dt.timedelta(minutes=rng.choice([0, 1, 50, 1440, 3000, 44_000, 90_000, 400_000]) + rng.randrange(3))
        if rng.random() < 0.5:
            low, high = (dt.datetime.combine(x, dt.time()) for x in (low.date(), high.date()))
        parts = ranges.split_range(low, high)
        spans = covered(parts)
        if low >= high:
            assert spans == []
            continue
        assert spans[0][0] == low and spans[-1][1] == high and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(b - a < dt.timedelta(days=1) or (a.time() != dt.time()) for a, b in parts.edges) and len(parts.edges) <= 2
        if parts.months:
            assert all(d.day == 1 for d in parts.months) and all((b - a).days < 31 for a, b in parts.days)


def test_day_bounds_and_text():
    assert ranges.split_range("2024-01-01", "2024-03-31") == ranges.RangeParts((dt.date(2024, 1, 1), dt.date(2024, 3, 1)), (), ())
    assert ranges.split_range("2024-02-10", dt.date(2024, 2, 12)).days == ((dt.date(2024, 2, 10), dt.date(2024, 2, 12)),)
    assert ranges.split_range("2024-01-31 23:00:00", "2024-01-31 23:30:00").edges == (
        (dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 1, 31, 23, 30)),)
    for bad in ("garbage", "2024-01-01 25:00:00 x", None, ""):
        with pytest.raises(ValueError):
            ranges.split_range(bad, "2024-01-01")


def test_rows_inside_are_not_read(spark):
    """With all raw rows inside the whole days and months deleted, the answer stays: only edges are read raw."""
    req = fixtures.requests_long(spark, SMALL).withColumn("opened", F.col("opened") + F.expr("make_dt_interval(0, crc32(case_id) % 24)"))
    daily, monthly = rollups.daily_agg(req), rollups.monthly_agg(req)
    low, high = dt.datetime(1996, 5, 7, 9, 30), dt.datetime(1998, 3, 20, 17, 0)
    inside = F.to_date("opened").between("1996-05-08", "1998-03-19")
    want = {(r["category"], r["district"]): r["n"] for r in req.where((F.col("opened") >= F.lit(str(low)).cast("timestamp_ntz"))
            & (F.col("opened") < F.lit(str(high)).cast("timestamp_ntz"))).groupBy("category", "district").agg(F.count("*").alias("n")).collect()}
    got = ranges.range_counts(req.where(~inside), daily, monthly, low, high, ("category", "district")).collect()
    assert {(r["category"], r["district"]): r["count"] for r in got} == want and want
    assert ranges.range_counts(req, daily, monthly, high, low).collect() == []
    whole = ranges.range_counts(req.where("false"), daily, monthly, "1996-05-01", "1996-06-30").agg(F.sum("count")).first()[0]
    assert whole == req.where(F.to_date("opened").between("1996-05-01", "1996-06-30")).count()


def series(categories, days, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(categories):
        for k in range(days):
            d = dt.date(2021, 1, 1) + dt.timedelta(days=k)
            level = 50 + 0.01 * k + 20 * np.sin(2 * np.pi * k / 365.25 + c) - 8 * (d.weekday() >= 5)
            rows.append((d, f"c{c}", int(max(0, round(level + rng.normal(0, 1))))))
    return rows


def test_season_is_found_and_beats_the_trend(spark):
    v = spark.createDataFrame(series(2, 1100), "date date, category string, volume long")
    m = {(r["model"], r["category"]): r for r in seasonal.compare_holdout(v).collect()}
    for c in ("c0", "c1"):
        assert m["seasonal", c]["rmse"] < 2 < m["trend_weekday", c]["rmse"] and m["seasonal", c]["r2"] > 0.9
    fc = seasonal.forecast_seasonal(seasonal.fit_seasonal(v), dt.date(2024, 1, 6), 40).collect()
    assert len(fc) == 80 and all(0 <= r["lower_bound"] <= r["predicted_volume"] <= r["upper_bound"] for r in fc)


def test_fit_is_the_normal_equations_and_parts_add_up(spark):
    rows = series(1, 200)
    v = spark.createDataFrame(rows, "date date, category string, volume long")
    t = np.array([(d - seasonal.ORIGIN).days / seasonal.YEAR for d, _, _ in rows])
    x = np.stack([np.ones_like(t), t, *[np.array([float(d.weekday() == k) for d, _, _ in rows]) for k in range(6)],
                  *[f(t * 2 * np.pi * k) for k in (1, 2, 3) for f in (np.sin, np.cos)]], axis=1)
    y = np.array([float(n) for _, _, n in rows])
    beta = np.linalg.solve(x.T @ x + np.diag([0] + [1.0] * 13), x.T @ y)
    got = seasonal.fit_seasonal(v).first()
    assert np.allclose(got["beta"], beta, atol=1e-8) and got["resid_std"] == pytest.approx(np.sqrt(np.mean((y - x @ beta) ** 2)), abs=1e-6)
    whole = seasonal.moments(v, ["category"]).first()
    parts = seasonal.moments(v.withColumn("part", F.month("date") % 3), ["category", "part"]).collect()
    assert np.allclose(np.sum([p["gram"] for p in parts], axis=0), whole["gram"]) and sum(p["n_days"] for p in parts) == 200


def test_short_and_empty_series(spark):
    v = spark.createDataFrame([(dt.date(2024, 1, 1), "one", 5), (dt.date(2024, 1, 1), None, 2)], "date date, category string, volume long")
    assert {r["category"]: round(r["beta"][0], 3) is not None for r in seasonal.fit_seasonal(v).collect()} == {"one": True, None: True}
    assert seasonal.fit_seasonal(v.where("false")).collect() == []
    assert seasonal.rolling_backtest(v, [dt.date(2024, 2, 1)], 7).collect() == []


def test_rolling_origins_equal_refitting(spark):
    rows = [r for r in series(2, 400) if r[0].weekday() != 3 or r[0] > dt.date(2021, 11, 1)]     # a weekday first seen late
    v = spark.createDataFrame(rows, "date date, category string, volume long")
    origins = [dt.date(2021, 3, 1), dt.date(2021, 8, 15), dt.date(2021, 8, 20), dt.date(2022, 1, 1), dt.date(2023, 1, 1)]
    got = {(r["category"], r["origin"]): (r["mape"], r["days"]) for r in seasonal.rolling_backtest(v, origins, 21).collect()}
    want = {}
    for o in origins:
        model, effects = forecast.fit_trend_weekday(v.where(F.col("date") < F.lit(o)))
        preds = forecast.forecast(model, effects, o, 21)
        want |= {(r["category"], o): (r["mape"], r["days"]) for r in forecast.backtest(preds, v).collect()}
    assert got == want and len(want) == 8


def test_rollups_of_one_scan_are_todays(spark):
    req = fixtures.requests_short(spark, SMALL)
    cube = rollups.hour_cube(req)
    assert cube._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    for name, fn in (("daily_agg", rollups.daily_agg), ("monthly_agg", rollups.monthly_agg), ("hourly_agg", rollups.hourly_agg),
                     ("daily_aggregates", rollups.daily_aggregates)):
        today, one = fn(req), rollups.OF_CUBE[name](cube)
        assert one.columns == today.columns
        assert Counter(map(tuple, one.collect())) == Counter(map(tuple, today.collect()))


def test_copies_are_numbered_without_a_hot_task(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("'same' AS category", "'Open' AS _row", "1 AS _copy", "if(id % 1000 = 0, id, 0) AS x")
    out = normalize.numbered_copies(df)
    rows = out.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["hash"], []).append(r["copy"])
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1, 3997] and all(sorted(g) == list(range(1, len(g) + 1)) for g in groups.values())
    assert normalize.load_projection(df).select("case_id").distinct().count() == 4000
    assert "row_number" not in out._jdf.queryExecution().toString()


def test_copies_are_dealt_by_rows_not_by_shuffled_bytes(spark, monkeypatch):
    """Equal rows shrink to next to nothing when shuffled or estimated: neither may fill a task or a broadcast."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500, raising=False)
    monkeypatch.setattr(normalize, "BLOCK_BITS", 6, raising=False)
    df = spark.range(0, 8000, 1, 2).selectExpr("CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN concat('u', id) ELSE 'b' END AS category")
    out = normalize.numbered_copies(df)
    rows = out.select("row.category", "copy", F.spark_partition_id().alias("task")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["category"], []).append(r["copy"])
    assert sorted(len(g) for g in groups.values()) == [1] * 2000 + [2000, 4000]
    assert all(sorted(g) == list(range(1, len(g) + 1)) for g in groups.values())
    assert max(Counter(r["task"] for r in rows).values()) < 1000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_sketch_stream_is_the_batch(spark, scratch):
    events = read_table(spark, SMALL, "events")
    landed = os.path.join(scratch, "landed")
    events.repartitionByRange(3, "ts").write.parquet(landed)
    rows = jobs.monitoring_rows(jobs.event_stream(spark, landed, events.schema, max_files_per_trigger=1))
    out = os.path.join(scratch, "sketches")
    q = jobs.start_latency_sketches(rows, out, width="1 hour", watermark="40 days", name="t03_sketch_test")
    q.awaitTermination(300)
    # finalised windows only: with this watermark the last ones stay open, so a closing row is sent after them
    late = events.limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    late.write.mode("append").parquet(landed)
    late.withColumn("ts", F.lit("2031-01-01 00:00:00").cast("timestamp_ntz")).write.mode("append").parquet(landed)
    q = jobs.start_latency_sketches(rows, out, width="1 hour", watermark="40 days", name="t03_sketch_test")
    q.awaitTermination(300)
    got = spark.read.parquet(out).where("window_start < '2030-01-01'")
    want = jobs.latency_sketches(jobs.monitoring_rows(events), "1 hour")
    assert Counter(map(tuple, jobs.sketch_percentiles(got).collect())) == Counter(map(tuple, jobs.sketch_percentiles(want).collect()))
    day = jobs.sketch_percentiles(jobs.merged_sketches(got, "1 day")).drop("requests")
    audit = jobs.ranks_within(jobs.monitoring_rows(events), day, "1 day", 2.5 * jobs.sketch_error()).collect()
    assert audit and all(r["p50_within"] and r["p95_within"] and r["p99_within"] for r in audit)


def test_merges_leave_no_tables(spark, scratch):
    req = fixtures.requests_short(spark, SMALL).withColumn("opened", F.col("opened").cast("timestamp"))
    path, before = os.path.join(scratch, "table"), list(session._OWNED)
    folder = os.path.join(session.checkpoint_dir(spark), "materialized")
    count = lambda: len(os.listdir(folder)) if os.path.isdir(folder) else 0                  # noqa: E731
    tables = count()
    for k in range(10):
        jobs.merge_daily_batch(jobs.daily_windows(req.where(F.dayofmonth("opened") % 10 == k)), path)
    assert session._OWNED == before and count() == tables
    assert spark.read.parquet(path).agg(F.sum("count")).first()[0] == req.count()


def test_alert_runs_on_timers_equal_the_batch_in_any_order(spark, scratch):
    """Windows of two keys in shuffled micro-batches, each inside the watermark of those before it."""
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=k), 0.01 if rng.random() < 0.25 else 0.05 + rng.randrange(1, 90) / 100, c) for c in "ab" for k in range(300)]
    schema = "window_start timestamp_ntz, error_rate double, node string"
    batch = jobs.sustained_alerts(spark.createDataFrame(rows, schema), keys=["node"], min_windows=4)
    want = sorted((r["node"], r["alert_start"], r["last_window"], r["windows"], r["peak_rate"]) for r in batch.collect())
    assert len(want) > 10
    rows.sort(key=lambda r: r[0] + dt.timedelta(minutes=rng.randrange(25)))                  # late by up to 25 minutes
    landed = os.path.join(scratch, "windows")
    far = [(base + dt.timedelta(days=9 + k), 0.9, c) for k in range(2) for c in "ab"]        # closes the last runs
    cuts = [rows[k:k + 150] for k in range(0, len(rows), 150)] + [far]
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = os.path.join(scratch, "alerts")
        for part in cuts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
            runs = jobs.alert_runs(spark.readStream.schema(schema).parquet(landed), min_windows=4, watermark="30 minutes", key="node")
            q = runs.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(
                availableNow=True).start(out)
            q.awaitTermination(200)
    finally:
        spark.conf.set(conf, before)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want

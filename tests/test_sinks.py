"""Sinks: rollup build job, incremental partition refresh, CSV export, warehouse append."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from civicflow.sources import fixtures, sinks
from fixture_tables import SMALL


def test_build_rollups_job(spark, scratch):
    raw = fixtures.portal_requests(spark, SMALL)
    paths = sinks.build_rollups(spark, raw, scratch)
    daily = spark.read.parquet(paths["daily_agg"])
    clean = spark.read.parquet(paths["requests_clean"])
    assert daily.agg(F.sum("count")).first()[0] == clean.count() == raw.count()
    meta = spark.read.json(paths["metadata"])
    assert {r["rollup"] for r in meta.collect()} == {"daily_agg", "monthly_agg", "grid_agg", "hourly_agg",
                                                      "resolution_agg", "recent_raw"}


def test_refresh_keeps_old_partitions(spark, scratch):
    path = os.path.join(scratch, "crime_agg")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    sinks.refresh_partitions(spark.createDataFrame([(d1, 1, 5), (d2, 1, 6)], "date date, district int, count long"),
                             path)
    sinks.refresh_partitions(spark.createDataFrame([(d2, 1, 9)], "date date, district int, count long"), path)
    got = {(r["date"], r["count"]) for r in spark.read.parquet(path).collect()}
    assert got == {(d1, 5), (d2, 9)}


def test_export_csv_and_empty_range(spark, scratch):
    req = fixtures.requests_short(spark, SMALL)
    sinks.export_csv(req, os.path.join(scratch, "csv"), "2024-01-02", "2024-01-03")
    back = spark.read.option("header", True).csv(os.path.join(scratch, "csv"))
    assert back.count() == req.where("opened >= '2024-01-02' AND opened < '2024-01-04'").count()
    with pytest.raises(sinks.NoRowsInRange):
        sinks.export_csv(req, os.path.join(scratch, "none"), "1990-01-01", "1990-01-02")


def test_warehouse_append_allows_new_columns(spark, scratch):
    path = os.path.join(scratch, "wh")
    req = fixtures.requests_short(spark, SMALL)
    sinks.warehouse_append(req.limit(50), path)
    sinks.warehouse_append(req.limit(50).withColumn("neighborhood", F.lit("x")), path)
    back = sinks.read_warehouse(spark, path)
    assert "neighborhood" in back.columns and back.count() == 100


def test_predictions_table_partitioned_write(spark, scratch):
    from civicflow.operators import forecast
    from civicflow.plans.context import Ctx
    c = Ctx(spark, SMALL)
    model, effects = forecast.fit_trend_weekday(forecast.daily_volumes(c.long))
    fc = forecast.forecast(model, effects, dt.date(2001, 8, 2), 7)
    preds = forecast.predictions_table(fc, "trend_weekday", "v1", dt.datetime(2001, 8, 1))
    path = os.path.join(scratch, "predictions")
    sinks.write_predictions(preds, path)
    back = spark.read.parquet(path)
    assert back.select("prediction_date").distinct().count() == 7
    assert back.count() == preds.count() == 7 * model.count()
    assert back.where("predicted_volume < 0 OR lower_bound > predicted_volume").count() == 0


def test_sanitize_and_table_loader(spark):
    from civicflow.operators import normalize
    from civicflow.sources.tables import read_tables
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert [r["x"] for r in normalize.sanitize(df).collect()] == [1.0, None, None]
    got = read_tables(spark, SMALL, ["events", "orders", "no_such_table"])
    assert set(got) == {"events", "orders"}


def test_scale_conf_sizes_partitions():
    from civicflow.session import scale_conf
    conf = scale_conf(100 * 1024 ** 4, 8000)                   # 100 TiB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600   # 100 TiB / 256 MiB
    assert scale_conf(1024, 16)["spark.sql.shuffle.partitions"] == "32"   # never below 2x cores


def test_refresh_recent_only_touches_last_days(spark, scratch):
    path = os.path.join(scratch, "crime_recent")
    d = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    first = spark.createDataFrame([(x, 1, 1) for x in d], "date date, district int, count long")
    sinks.refresh_partitions(first, path)
    second = spark.createDataFrame([(x, 1, 2) for x in d], "date date, district int, count long")
    sinks.refresh_recent(second, path, as_of=dt.date(2024, 2, 10), days=10)
    got = {r["date"]: r["count"] for r in spark.read.parquet(path).collect()}
    assert got[dt.date(2024, 1, 1)] == 1 and got[dt.date(2024, 2, 9)] == 2 and len(got) == 40

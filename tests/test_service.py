"""The endpoint facade over written rollups answers like the raw path."""

import datetime as dt
import os

from pyspark.sql import functions as F

from civicflow.plans.context import Ctx
from civicflow.plans.service import RequestAnalytics
from civicflow.sources import fixtures, sinks
from fixture_tables import SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_facade_over_written_rollups(spark, scratch):
    c = Ctx(spark, SMALL)
    out = os.path.join(scratch, "agg")
    paths = sinks.build_rollups(spark, fixtures.portal_requests(spark, SMALL), out)
    sinks.build_side_tables(spark, out, c.events, c.closures, c.permits, c.crime, c.weather)
    svc = RequestAnalytics.from_paths(spark, paths["requests_clean"], out, as_of=dt.date(2024, 2, 1))
    assert {"daily_agg", "grid_agg", "events_by_date", "weather_agg"} <= set(svc.rollups)
    raw_only = RequestAnalytics(spark, svc.requests, {}, as_of=dt.date(2024, 2, 1))
    # long range -> rollup route; must equal the raw answer (null districts are kept)
    a = svc.daily_timeseries("2023-10-01", "2024-01-31").select("date", "count")
    b = raw_only.daily_timeseries("2023-10-01", "2024-01-31").select("date", "count")
    assert _rows(a) == _rows(b) and a.count() > 0
    assert _rows(svc.day_of_week("2023-10-01", "2024-01-31")) == _rows(raw_only.day_of_week("2023-10-01", "2024-01-31"))
    assert _rows(svc.hourly_pattern()) == _rows(raw_only.hourly_pattern())
    assert svc.map_data("2023-10-01", "2024-01-31").columns[:3] == ["category", "rank", "color"]
    assert "lat_cell" in svc.map_data("2024-01-01", "2024-01-10", fmt="heatmap").columns
    assert svc.freshness().count() == 4
    assert svc.predict_volume("click", 7, dt.date(2024, 2, 1)).count() == 7
    assert svc.predict_trends("all", "7d", dt.date(2024, 2, 1)).count() == 5
    cmp = svc.compare_periods("2024-01-01", "2024-01-15", "2024-01-16", "2024-01-30").first()
    assert cmp["base_total"] > 0 and cmp["compare_total"] > 0


def test_date_filter_prunes_day_partitions(spark, scratch):
    import contextlib
    import io
    from civicflow.operators import filters
    out = os.path.join(scratch, "agg")
    paths = sinks.build_rollups(spark, fixtures.portal_requests(spark, SMALL), out)
    clean = spark.read.parquet(paths["requests_clean"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        filters.filter_date_range(clean, "2024-01-03", "2024-01-05").explain("formatted")
    import re
    text = re.sub(r"#\d+", "", buf.getvalue())
    assert "PartitionFilters: [isnotnull(opened_date), (opened_date >= 2024-01-03), (opened_date <= 2024-01-05)]" in text


def _built(spark, folder):
    c = Ctx(spark, SMALL)
    paths = sinks.build_rollups(spark, fixtures.portal_requests(spark, SMALL), folder)
    sinks.build_side_tables(spark, folder, c.events, c.closures, c.permits, c.crime, c.weather)
    return RequestAnalytics.from_paths(spark, paths["requests_clean"], folder, as_of=dt.date(2024, 2, 1))


def test_every_method_answers_on_built_tables_and_after_a_rebuild(spark, scratch):
    out = os.path.join(scratch, "agg")
    for _ in range(2):                                        # the second build replaces the files of the first
        svc = _built(spark, out)
        assert svc.recent(5).count() == 5
        assert all(r["id"] != "N/A" and r["status"] in ("Open", "Closed") for r in svc.recent(50).collect())
    whole = [svc.categories(), svc.stats(), svc.top_categories(), svc.daily_timeseries(), svc.weather(), svc.freshness(),
             svc.day_of_week(), svc.hourly_pattern(), svc.weather_impact(), svc.monthly_trends(), svc.events_by_date(),
             svc.correlation("crime"), svc.district_breakdown(), svc.resolution_by_hour_opened(), svc.anomalies(),
             svc.map_data(), svc.compare_periods("2024-01-01", "2024-01-10"), svc.category_timeseries("click"),
             svc.predict_volume("click"), svc.predict_trends(), svc.predict_hotspots(), svc.predict_hotspots("2024-01-15"),
             *svc.category_insights(), *svc.event_correlation(), *svc.resolution_time(), *svc.correlation()]
    for df in whole:
        assert df.columns and df.count() >= 0
    svc.export(os.path.join(scratch, "csv"), "2024-01-02", "2024-01-03")


def test_wrong_requests_are_refused(spark, scratch):
    import pytest
    svc = RequestAnalytics(spark, fixtures.requests_short(spark, SMALL))
    for call in (lambda: svc.recent(5000), lambda: svc.recent(0), lambda: svc.predict_trends("all", "1y"),
                 lambda: svc.predict_volume("click", 31), lambda: svc.predict_volume("click", model="x"),
                 lambda: svc.daily_timeseries("last week", None), lambda: svc.correlation("x")):
        with pytest.raises(ValueError):
            call()


def test_empty_rollup_falls_back_to_raw(spark):
    req = fixtures.requests_short(spark, SMALL)
    from civicflow.operators import rollups
    empty = {n: f(req).where("1 = 0") for n, f in rollups.ROLLUPS.items() if n in ("daily_agg", "monthly_agg", "grid_agg")}
    svc = RequestAnalytics(spark, req, empty)
    raw = RequestAnalytics(spark, req)
    span = ("2023-10-01", "2024-01-31")
    assert _rows(svc.daily_timeseries(*span)) == _rows(raw.daily_timeseries(*span)) != []
    assert _rows(svc.day_of_week(*span)) == _rows(raw.day_of_week(*span))
    assert _rows(svc.monthly_trends(*span)) == _rows(raw.monthly_trends(*span)) != []
    assert "lat" in svc.map_data(*span).columns


def test_trees_are_saved_reloaded_and_forecast(spark, scratch):
    from civicflow.operators import forecast
    req = Ctx(spark, SMALL).long
    features = forecast.volume_features(req)
    model, pred = forecast.train_gbt(features, max_iter=4, max_depth=3, min_rows=50)
    meta = forecast.model_metadata("gbt", features, pred, dt.datetime(2024, 1, 1))
    path = os.path.join(scratch, "gbt")
    forecast.save_gbt(model, path, meta)
    svc = RequestAnalytics(spark, req)
    category = meta.first()["category"]
    got = svc.predict_volume(category, 30, dt.date(2001, 8, 2), model="gbt", model_path=path).collect()
    assert len(got) == 30 and all(0 <= r["lower_bound"] <= r["predicted_volume"] <= r["upper_bound"] for r in got)
    assert len({r["yhat"] for r in got}) > 1
    row = spark.read.parquet(f"{path}/metadata").where(F.col("category") == category).first()
    assert row["validation_rows"] > 0 and row["rmse"] >= 0


def test_recent_slice_and_recent_rollup_prune_day_partitions(spark, scratch):
    import contextlib
    import io
    from civicflow.operators import filters, rollups, volume
    clean = _built(spark, os.path.join(scratch, "agg")).requests

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        return buf.getvalue()

    for df in (rollups.recent_by_category(clean, dt.date(2024, 1, 31), 7), filters.recent_slice(clean, 7),
               volume.compare_periods(clean, None, "2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14")):
        assert any("opened_date" in line and ">=" in line for line in plan(df).splitlines() if "PartitionFilters" in line)
    last = clean.agg(F.max("opened")).first()[0]
    want = clean.where(F.col("opened") >= F.lit(last - dt.timedelta(days=7))).count()
    assert filters.recent_slice(clean, 7).count() == want > 0

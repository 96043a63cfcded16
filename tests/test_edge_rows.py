"""Hand-made edge rows (FIXTURES.md §3), checked against hand-computed answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicflow.functions.calendar import calendar_features
from civicflow.operators import anomaly, district, events, filters, normalize, rollups, volume
from civicflow.operators import resolution as res
from civicflow.operators import geo
from civicflow.sources import fixtures, landing

CLEAN = ("case_id string, opened timestamp_ntz, closed timestamp_ntz, category string, status string, "
         "district int, latitude double, longitude double, address string")


def req(spark, rows):
    df = spark.createDataFrame(rows, CLEAN)
    return df.withColumn("resolution_hours", F.expr("timestampdiff(MICROSECOND, opened, closed)") / F.lit(3.6e9))


def T(s):
    return dt.datetime.fromisoformat(s)


def test_normalizer_bad_values(spark):
    raw = spark.createDataFrame([
        ("1", "2024-01-02 10:00:00", "2024-01-02 12:00:00", "Graffiti", "5"),
        ("2", "not a date", None, None, "abc"),
        ("3", "2024-01-03 08:00:00", "2024-01-02 08:00:00", None, None),
    ], "service_request_id string, requested_datetime string, closed_date string, service_name string, "
       "supervisor_district string")
    clean = {r["service_request_id"]: r for r in normalize.normalize_requests(raw).collect()}
    assert set(clean) == {"1", "3"}                       # unparsable opened dropped
    assert clean["3"]["category"] == "Unknown"            # null category filled
    assert clean["3"]["resolution_hours"] == -24.0        # closed before opened kept as negative
    assert clean["1"]["district"] == 5
    fetched = {r["service_request_id"]: r for r in normalize.clean_fetched(raw).collect()}
    assert fetched["2"]["opened"] is None and fetched["2"]["supervisor_district"] is None   # kept, coerced


def test_resolution_validity_bounds(spark):
    o = T("2024-01-01 00:00:00")
    rows = [(str(i), o, o + dt.timedelta(hours=h), "c", None, 1, None, None, None)
            for i, h in enumerate([0.0, 8759.99, 8760.0, -1.0, 5.0] + [1.0] * 10)]
    df = req(spark, rows)
    kept = sorted(r["resolution_hours"] for r in filters.valid_resolution(df).collect())
    assert 0.0 in kept and 8759.99 in [round(x, 2) for x in kept]
    assert 8760.0 not in kept and -1.0 not in kept
    ra = rollups.resolution_agg(df).collect()[0]         # A-05 keeps only hours > 0 (no upper bound)
    assert ra["count"] == 13
    by_cat = res.resolution_by_category(df, 10).collect()[0]   # A-20: 0 <= h < 8760
    assert by_cat["sample_size"] == 13


def test_box_edges_and_truncating_snap(spark):
    o = T("2024-01-01 00:00:00")
    rows = [("a", o, None, "c", None, 1, 37.5, -122.5, None), ("b", o, None, "c", None, 1, 38.0, -122.5, None),
            ("c", o, None, "c", None, 1, 37.7, -123.0, None), ("d", o, None, "c", None, 1, 37.7, -122.0, None),
            ("e", o, None, "c", None, 1, 37.7749, -122.419, None)]
    df = req(spark, rows)
    grid = rollups.grid_agg(df)
    assert grid.agg(F.sum("count")).first()[0] == 5                       # closed box keeps the edges
    pts = geo.map_points(df).collect()
    assert [p["lat"] for p in pts] == [37.7749]                            # open box drops them
    cell = grid.where("lat_id = 3777").first()
    assert cell["lon_id"] == -12241 and abs(cell["lon_cell"] - (-122.41)) < 1e-9   # not -122.42


def _events(spark, rows):
    df = spark.createDataFrame(rows, "event_start_date date, event_name string, seq long")
    return landing.normalize_events(df, ["seq"])


def test_event_names_dedup_cut_and_limit(spark):
    d = dt.date(2024, 1, 5)
    names = ["Same", "Same"] + [f"n{i}" for i in range(9)]
    ev = _events(spark, [(d, n, i) for i, n in enumerate(names)])
    got = events.events_by_date(ev, None, None).first()["event_names"].split("|")
    assert got == ["Same"] + [f"n{i}" for i in range(7)]                 # ordered de-dup, first 8
    lens = {80: "x" * 80, 81: "y" * 81, 100: "z" * 100, 120: "w" * 120}
    ev2 = _events(spark, [(d, s, i) for i, s in enumerate(lens.values())])
    got2 = events.events_by_date(ev2, None, None).first()["event_names"].split("|")
    assert got2 == ["x" * 80, "y" * 80 + "…", "z" * 80 + "…"]           # 120 dropped (< 120 rule)
    cl = spark.createDataFrame([(d, "q" * 95, "ST", 1), (d, "r" * 90, "ST", 2)],
                               "start_date date, case_name string, street string, seq long")
    got3 = events.events_by_date(None, landing.normalize_closures(cl, ["seq"]), None).first()["event_names"]
    assert got3 == "r" * 80 + "…"                                         # 95 + ' (ST)' = 100 chars: dropped


def test_district_null_and_fallback_name(spark):
    o = T("2024-01-01 00:00:00")
    rows = [("a", o, None, "c", None, None, None, None, None), ("b", o, None, "c", None, 3, None, None, None),
            ("c", o, None, "c", None, 17, None, None, None)]
    df = req(spark, rows)
    out = {r["district"]: r for r in district.district_breakdown(df, fixtures.districts(spark)).collect()}
    assert set(out) == {3, 17} and out[17]["name"] == "District 17" and out[3]["percentage"] == 50.0
    assert rollups.daily_agg(df).agg(F.sum("count")).first()[0] == 3
    assert rollups.daily_agg(df, drop_null_keys=True).agg(F.sum("count")).first()[0] == 2


def _daily_rows(counts_by_day, category, start=dt.date(2024, 1, 1)):
    rows = []
    for i, n in enumerate(counts_by_day):
        day = dt.datetime.combine(start + dt.timedelta(days=i), dt.time(12))
        rows += [(f"{category}-{i}-{j}", day, None, category, None, 1, None, None, None) for j in range(n)]
    return rows


def test_anomaly_constant_series_and_exact_threshold(spark):
    flat = _daily_rows([3] * 37, "flat")                                 # std 0: never flagged
    # the 30 days before the last day alternate 0, 2: mean 1, population std 1
    exact = _daily_rows([1] * 6 + [0, 2] * 15 + [3], "exact")            # z = 2.0 exactly: not flagged
    spike = _daily_rows([1] * 6 + [0, 2] * 15 + [4], "spike")            # z = 3
    out = anomaly.anomalies(req(spark, flat + exact + spike)).collect()
    assert [(r["category"], r["deviation_factor"]) for r in out] == [("spike", 3.0)]


def test_top_k_tie_at_rank_ten(spark):
    o = T("2024-01-01 00:00:00")
    rows = []
    for i, cat in enumerate("abcdefghijkl"):
        n = 5 if cat in "jkl" else 20 - i
        rows += [(f"{cat}{j}", o, None, cat, None, 1, None, None, None) for j in range(n)]
    top = [r["category"] for r in volume.top_k(req(spark, rows), "category", 10).collect()]
    assert top[-1] == "j" and "k" not in top                              # tie broken by name


def test_weekday_without_rows_and_iso_week(spark):
    rows = [(str(i), T(f"2024-01-0{d} 09:00:00"), None, "c", None, 1, None, None, None)
            for i, d in enumerate([1, 2, 3, 4, 5, 6])]                   # Mon..Sat, no Sunday
    prof = volume.day_of_week_profile(req(spark, rows)).collect()
    assert len(prof) == 7 and prof[6]["count"] == 0 and prof[6]["percentage"] == 0.0
    wk = calendar_features(spark.createDataFrame([(T("2024-12-30 00:00:00"),)], "opened timestamp_ntz"))
    assert wk.first()["week_of_year"] == 1 and wk.first()["day_of_week"] == 0


def test_days_in_range_and_routing():
    assert filters.days_in_range(None, None) is None
    assert filters.days_in_range("2024-01-01", "2024-03-31") == 90
    assert filters.days_in_range("2024-01-01", None, dt.date(2024, 1, 11)) == 10
    assert filters.days_in_range("garbage", "2024-01-01") is None


def test_districts_that_are_no_integers_become_null(spark):
    raw = spark.createDataFrame([(str(k), "2024-01-02 10:00:00", d) for k, d in enumerate(("5", "NaN", "1e12", "-inf", "3.7", "x"))],
                                "service_request_id string, requested_datetime string, supervisor_district string")
    clean = {r["service_request_id"]: r["district"] for r in normalize.normalize_requests(raw).collect()}
    assert clean == {"0": 5, "1": None, "2": None, "3": None, "4": 3, "5": None}
    crime = landing.normalize_crime(raw.withColumnRenamed("requested_datetime", "incident_date"))
    assert [r["district"] for r in crime.collect()] == [5, None, None, None, 3, None]
    assert len(normalize.recent_rows(raw.withColumnsRenamed({"requested_datetime": "opened", "supervisor_district": "district"})
                                     .withColumn("closed", F.lit(None).cast("string")), 10).collect()) == 6


def test_day_bounds_in_usual_forms():
    day = dt.date(2024, 1, 5)
    for s in ("2024-01-05", "2024/01/05", "01/05/2024", "2024-01-05T10:00:00", "20240105", "Jan 5, 2024", "5 January 2024", day):
        assert filters.parse_day(s) == day
    assert filters.parse_day(None) is None and filters.parse_day("") is None
    for s in ("last week", "2024-13-01", "05"):
        with pytest.raises(ValueError):
            filters.parse_day(s)


def test_names_without_a_sequence_are_settled_by_name(spark):
    rows = [("2024-01-01", f"name {k:02d}") for k in range(20)]
    want = "|".join(n for _, n in rows[:8])
    for order in (rows, rows[::-1]):
        ev = landing.normalize_events(spark.createDataFrame(order, "date string, event_name string").repartition(3))
        assert events.events_by_date(ev, None, None).first()["event_names"] == want


def test_weather_impact_keeps_its_overall_row_without_dry_days(spark):
    from civicflow.operators import weather
    o = T("2024-01-01 10:00:00")
    df = req(spark, [("1", o, None, "c", None, 1, None, None, None)])
    wet = spark.createDataFrame([(o.date(), 1)], "date date, rain_day int")
    assert [tuple(r) for r in weather.weather_impact(df, wet).collect()] == [(None, 1.0, None, 0.0)]


def test_load_ids_differ_for_equal_rows(spark):
    df = spark.createDataFrame([("2024-01-01", "a")] * 3 + [("2024-01-01", "b")], "opened string, category string")
    ids = [r["case_id"] for r in normalize.load_projection(df).collect()]
    again = [r["case_id"] for r in normalize.load_projection(df.repartition(3)).collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(again)

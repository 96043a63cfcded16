"""Landing readers (JSON portal records, weather documents) and routing fallbacks."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from civicflow.operators import rollups
from civicflow.plans import routing
from civicflow.sources import fixtures, landing
from fixture_tables import SMALL


def test_portal_json_roundtrip(spark, scratch):
    portal = fixtures.portal_requests(spark, SMALL)
    path = os.path.join(scratch, "portal_json")
    portal.write.json(path)
    got = landing.read_portal_json(spark, path, "2024-01-03", "2024-01-05", schema=portal.schema)
    want = landing.portal_records(portal, "2024-01-03", "2024-01-05")
    cols = ["service_request_id", "requested_datetime", "supervisor_district"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())
    assert got.count() > 0


def test_weather_json_documents(spark, scratch):
    doc = {"daily": {"time": ["2024-01-01", "2024-01-02", "2024-01-03"],
                     "temperature_2m_max": [14.0, None, 12.5],
                     "temperature_2m_min": [8.0, 7.5, 6.0],
                     "precipitation_sum": [0.0, 0.1, None]}}
    path = os.path.join(scratch, "weather")
    os.makedirs(path)
    with open(os.path.join(path, "doc.json"), "w") as f:
        f.write(json.dumps(doc))
    rows = {r["date"]: r for r in landing.weather_from_json(spark, path).collect()}
    assert rows[dt.date(2024, 1, 2)]["rain_day"] == 0          # 0.1 is not > 0.1
    assert rows[dt.date(2024, 1, 3)]["rain_day"] == 0          # null precipitation counts as 0
    assert rows[dt.date(2024, 1, 2)]["temp_max_c"] is None


def test_routing_falls_back_to_raw_when_rollup_empty(spark):
    req = fixtures.requests_long(spark, SMALL)
    empty = rollups.daily_agg(req).where(F.lit(False))
    a = routing.daily_counts(req, empty, "1996-01-01", "1998-12-31", check_empty=True)
    b = routing.daily_counts(req, None, "1996-01-01", "1998-12-31")
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
    assert routing.use_rollup("1996-01-01", "1998-12-31") and not routing.use_rollup("1996-01-01", "1996-03-31")

"""Landed record files as a data source: day pruning, splits inside files, unreadable lines."""

import datetime as dt
import gzip
import io
import os

import pytest
from civicflow.sources.landed_records import lines_between, read_landed
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType().add("id", "long").add("name", "string")


def land(root, folder, name, data):
    os.makedirs(os.path.join(root, folder), exist_ok=True)
    with open(os.path.join(root, folder, name), "wb") as f:
        f.write(data)


def test_splits_hold_every_line_once():
    data = b"\n".join(b"x" * (k * 7 % 23) for k in range(200))
    for size in (1, 2, 5, 22, 23, 64, len(data), len(data) + 9):
        got = [x for k in range(0, len(data), size) for x in lines_between(io.BytesIO(data), k, min(k + size, len(data)))]
        assert [x for x in got if x] == [x for x in data.split(b"\n") if x], size


def test_unreadable_lines_are_kept_and_counted(spark, scratch):
    land(scratch, "day=2024-01-01", "a.json", b'{"id": 1, "name": "x"}\n\n{"id": 2, "na\n[1]\nnull\n{"id": "two"}\n{}\n')
    land(scratch, "day=2024-01-02", "b.json.gz", gzip.compress(b'{"id": 3, "name": "\xff"}\n{"id": 4}'))
    land(scratch, "day=soon", "c.json", '{"id": 5, "name": "é", "more": 1}'.encode())
    land(scratch, "day=2024-01-03", "_SUCCESS", b"not a record")
    for size in (3, 64 << 20):
        rows = read_landed(spark, scratch, FIELDS, split_bytes=size).collect()
        assert len(rows) == 9
        assert sorted(r["id"] for r in rows if r["unreadable"] is None and r["id"]) == [1, 4, 5]
        assert {r["unreadable"] for r in rows} == {
            None, '{"id": 2, "na', "[1]", "null", '{"id": "two"}', '{"id": 3, "name": "�"}'}
        assert [(r["day"], r["name"]) for r in rows if r["id"] == 5] == [(None, "é")]


def test_day_conditions_open_no_other_folder(spark, scratch):
    for k in range(1, 10):
        land(scratch, f"day=2024-01-0{k}", "a.json", b'{"id": %d}\n' % k)
    land(scratch, "day=2024-01-08", "broken.json.gz", b"no gzip data")          # fails when it is opened
    rows = read_landed(spark, scratch, FIELDS)
    with pytest.raises(Exception):
        rows.count()
    some = rows.where((F.col("day") >= dt.date(2024, 1, 3)) & (F.col("day") < dt.date(2024, 1, 6)) & (F.col("id") != 4))
    assert sorted(r["id"] for r in some.collect()) == [3, 5] and some.rdd.getNumPartitions() == 3
    assert [r["id"] for r in rows.where(F.col("day") == dt.date(2024, 1, 2)).collect()] == [2]
    assert sorted(r["id"] for r in rows.where(F.col("day").isin(dt.date(2024, 1, 1), dt.date(2024, 1, 9))).collect()) == [1, 9]
    assert rows.where(F.col("day") > dt.date(2025, 1, 1)).count() == 0


def test_no_files_and_clashing_names(spark, scratch):
    assert read_landed(spark, scratch, FIELDS).count() == 0
    with pytest.raises(ValueError):
        read_landed(spark, scratch, T.StructType().add("Day", "string"))

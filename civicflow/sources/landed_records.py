"""Landed record files as a data source (S-03, S-04).

Files of one JSON object a line lie in folders ``<path>/day=YYYY-MM-DD``. The source lists
the day folders that the pushed-down filters leave, cuts their files into byte ranges, and
hands on whole lines; Spark parses them. A huge day is many tasks, and a day outside the
wanted range is never opened, or even listed.
"""

from __future__ import annotations

import datetime as dt
import operator
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package

COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
           LessThanOrEqual: operator.le, In: lambda day, days: day in days}
BLOCK = 1 << 20


@dataclass
class Split(InputPartition):
    """The lines of ``file`` that begin at bytes ``start`` to ``end`` (to its last where None)."""
    day: dt.date | None
    file: str
    start: int
    end: int | None


def day_of(folder: str) -> dt.date | None:
    """``day=2024-01-05`` -> that date; any other name -> None."""
    try:
        return dt.date.fromisoformat(folder.removeprefix("day=")) if folder.startswith("day=") else None
    except ValueError:
        return None


def lines_between(stream, start: int, end: int | None) -> Iterator[bytes]:
    """Lines of an open file whose first byte lies in [start, end), a block in memory at a time."""
    at = max(start - 1, 0)
    if at:
        stream.seek(at)
    skip, rest = start > 0, b""             # what precedes the first line end belongs to the split before
    while end is None or at < end:
        block = stream.read(BLOCK)
        *whole, rest = (rest + block).split(b"\n")
        if not block:
            whole, rest = [rest] if rest else [], b""
        for line in whole:
            if skip:
                skip = False
            elif end is not None and at >= end:
                return
            else:
                yield line
            at += len(line) + 1
        if not block:
            return


class LandedReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.wanted = path, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the comparisons of ``day`` with fixed days; the others stay with Spark."""
        for f in filters:
            if f.attribute == ("day",) and isinstance(f, IsNotNull):
                self.wanted.append((operator.is_not, None))
            elif getattr(f, "attribute", None) == ("day",) and type(f) in COMPARE:
                self.wanted.append((COMPARE[type(f)], f.value))
            else:
                yield f

    def keeps(self, day: dt.date | None) -> bool:
        return all(day is not None and test(day, value) for test, value in self.wanted)

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (
            fs.LocalFileSystem(), self.path)
        out = []
        for folder in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            day = day_of(folder.base_name)
            if folder.type != fs.FileType.Directory or folder.base_name[0] in "_." or not self.keeps(day):
                continue
            for file in sorted(store.get_file_info(fs.FileSelector(folder.path, recursive=True)), key=lambda i: i.path):
                if file.type != fs.FileType.File or file.base_name[0] in "_." or not file.size:
                    continue
                if file.base_name.endswith(".gz"):
                    out.append(Split(day, file.path, 0, None))
                else:
                    out += [Split(day, file.path, k, min(k + self.split_bytes, file.size))
                            for k in range(0, file.size, self.split_bytes)]
        return out

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:                   # no file at all
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else \
            fs.LocalFileSystem()
        packed = split.file.endswith(".gz")
        with store.open_input_stream(split.file, compression="gzip") if packed else store.open_input_file(split.file) as stream:
            held, size = [], 0
            for line in lines_between(stream, split.start, split.end):
                if line.strip():
                    held.append(line)
                    size += len(line)
                if size >= 4 * BLOCK or len(held) >= 10_000:
                    yield self._batch(split.day, held)
                    held, size = [], 0
            if held:
                yield self._batch(split.day, held)

    @staticmethod
    def _batch(day: dt.date | None, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([day] * len(lines), pa.date32()), pa.array(lines, pa.binary())],
                                          names=["day", "line"])


class LandedLines(DataSource):
    """``day, line`` of the files under the option ``path``; ``split_bytes`` (64 MB) sizes the tasks."""

    @classmethod
    def name(cls) -> str:
        return "landed_lines"

    def schema(self) -> str:
        return "day date, line binary"

    def reader(self, schema: T.StructType) -> LandedReader:
        return LandedReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))


def read_landed(spark: SparkSession, path: str, fields: T.StructType, *, split_bytes: int = 64 << 20) -> DataFrame:
    """``fields`` of each landed record, with ``day`` (of its folder; null where that names no
    date) and ``unreadable``: the line itself where it is no JSON object of these fields or not
    UTF-8 (replacement characters stand for its bad bytes), else null. No line is dropped but blank
    ones. An unreadable line keeps those fields that could be read; absent fields are null.
    ``fields`` must not hold the names ``day`` and ``unreadable``. Conditions on ``day`` prune
    folders. ``path`` is a folder, or a URI of a store that pyarrow opens (file, hdfs, s3, gs)."""
    clash = {"day", "unreadable"} & {n.lower() for n in fields.names}
    if clash:
        raise ValueError(f"fields hold the names of the source: {sorted(clash)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedLines)
    lines = spark.read.format("landed_lines").option("split_bytes", split_bytes).load(path)
    text = F.col("line").cast("string")
    whole = T.StructType([*fields.fields, T.StructField("unreadable", T.StringType())])
    record = F.from_json(F.make_valid_utf8(text), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})
    rows = lines.select("day", F.make_valid_utf8(text).alias("line"), F.is_valid_utf8(text).alias("ok"), record.alias("r"))
    bad = ~F.col("ok") | F.col("r.unreadable").isNotNull() | F.col("r").isNull()
    return rows.select("day", *[F.col("r").getField(n).alias(n) for n in fields.names],
                       F.when(bad, F.col("line")).alias("unreadable"))

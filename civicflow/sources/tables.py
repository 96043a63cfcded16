"""S-01: Parquet scans of the landed tables.

Scans are plain ``spark.read.parquet``; projection and filters written
downstream are pushed into the scan by Catalyst (``ReadSchema`` /
``PushedFilters`` in ``explain``), so callers never pre-select columns here.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def read_tables(spark: SparkSession, base_dir: str, names, schema_by_name=None) -> dict[str, DataFrame]:
    """S-02: load a set of named tables; names whose files are missing are skipped.

    Spark itself says whether a path is there, on whatever file system it is."""
    out = {}
    for name in names:
        try:
            out[name] = read_table(spark, base_dir, name, (schema_by_name or {}).get(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out

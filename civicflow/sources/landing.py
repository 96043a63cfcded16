"""Landed-record sources: S-03 portal records, S-04 side-table scans,
S-05 weather arrays, S-13 unified event table.

Column choice by presence (``df.columns``) is metadata-only and happens on the
driver; every value conversion is a JVM expression (``try_cast`` keeps ANSI
mode from failing on bad input: bad values become null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters

# --- fixed values: date columns tried in order, per source -----------------
EVENT_DATE_COLUMNS = ["event_start_date", "start_date", "start_datetime", "date"]
CLOSURE_DATE_COLUMNS = ["start_date", "closure_start_date", "closure_date", "date"]
PERMIT_DATE_COLUMNS = ["permit_creation_date", "Permit Creation Date", "filing_date", "issued_date", "date"]
CRIME_DATE_COLUMNS = ["incident_date", "report_datetime", "Report Date"]
EVENT_NAME_COLUMNS = ["event_name", "event_description"]
CLOSURE_NAME_COLUMNS = ["case_name", "type", "loc_desc"]
PERMIT_NAME_COLUMNS = ["address", "street_number", "permit_number"]
CRIME_DISTRICT_COLUMNS = ["police_district", "supervisor_district"]

WEATHER_SCHEMA = T.StructType([
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
    ])),
])


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def as_date(c: Column, dtype: T.DataType) -> Column:
    """Coerce any date-ish column to DATE; unparsable -> null."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.to_date(c.cast("string").try_cast("timestamp_ntz"))


def pick_date(df: DataFrame, candidates: list[str], out: str) -> DataFrame:
    """S-04: ``out`` = first present candidate, parsed as a date (else null)."""
    src = first_present(df, candidates)
    if src is None:
        return df.withColumn(out, F.lit(None).cast("date"))
    return df.withColumn(out, as_date(F.col(src), df.schema[src].dataType))


def _seq(df: DataFrame, seq_cols: list[str] | None) -> Column:
    """Explicit record order (Spark rows have none): a struct of the given keys."""
    cols = seq_cols or []
    return F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(0).alias("_"))


def normalize_events(df: DataFrame, seq_cols: list[str] | None = None) -> DataFrame:
    """Community events -> event_date, name, seq."""
    df = pick_date(df, EVENT_DATE_COLUMNS, "event_date")
    name_col = first_present(df, EVENT_NAME_COLUMNS) or df.columns[0]
    return df.select("event_date", F.col(name_col).cast("string").alias("name"), _seq(df, seq_cols).alias("seq"))


def normalize_closures(df: DataFrame, seq_cols: list[str] | None = None) -> DataFrame:
    """Street closures -> closure_date, name, street, seq."""
    df = pick_date(df, CLOSURE_DATE_COLUMNS, "closure_date")
    name_col = first_present(df, CLOSURE_NAME_COLUMNS) or df.columns[0]
    street = F.col("street").cast("string") if "street" in df.columns else F.lit(None).cast("string")
    return df.select("closure_date", F.col(name_col).cast("string").alias("name"), street.alias("street"),
                     _seq(df, seq_cols).alias("seq"))


def normalize_permits(df: DataFrame, seq_cols: list[str] | None = None) -> DataFrame:
    """Building permits -> date, event_type='construction', name (first 80 chars), seq; null dates dropped."""
    df = pick_date(df, PERMIT_DATE_COLUMNS, "date")
    name_col = "name" if "name" in df.columns else (first_present(df, PERMIT_NAME_COLUMNS) or df.columns[0])
    return (df.select("date", F.lit("construction").alias("event_type"),
                      F.left(F.col(name_col).cast("string"), F.lit(80)).alias("name"), _seq(df, seq_cols).alias("seq"))
            .where(F.col("date").isNotNull()))


def normalize_crime(df: DataFrame) -> DataFrame:
    """Incidents -> date, district (numeric, null when absent/unparsable)."""
    df = pick_date(df, CRIME_DATE_COLUMNS, "date")
    dcol = first_present(df, CRIME_DISTRICT_COLUMNS)
    district = (F.col(dcol).cast("string").try_cast("double").try_cast("int") if dcol
                else F.lit(None).cast("int"))
    return df.select("date", district.alias("district"))


def weather_from_json(spark: SparkSession, path: str) -> DataFrame:
    """S-05: parallel daily arrays -> one row per day; rain_day = coalesce(precip, 0) > 0.1."""
    raw = spark.read.schema(WEATHER_SCHEMA).json(path)
    return weather_from_arrays(raw)


def weather_from_arrays(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.inline(F.arrays_zip(
        F.col("daily.time").alias("time"),
        F.col("daily.temperature_2m_max").alias("temp_max_c"),
        F.col("daily.temperature_2m_min").alias("temp_min_c"),
        F.col("daily.precipitation_sum").alias("precip_mm"))))
    return rows.select(F.to_date(F.col("time").try_cast("timestamp_ntz")).alias("date"),
                       "temp_max_c", "temp_min_c", "precip_mm",
                       (F.coalesce(F.col("precip_mm"), F.lit(0.0)) > 0.1).cast("int").alias("rain_day"))


def portal_records(df: DataFrame, start: str, end: str, limit: int | None = None,
                   date_col: str = "requested_datetime", tiebreak: str | None = None) -> DataFrame:
    """S-03: records with ``start <= date <= end 23:59:59``, newest first, optionally limited
    (``orderBy.limit`` -> TakeOrderedAndProject; ``tiebreak`` makes the cut deterministic)."""
    ts = F.col(date_col).cast("string").try_cast("timestamp_ntz")
    order = [F.desc("_ts")] + ([F.desc(tiebreak)] if tiebreak else [])
    out = filters.filter_date_range(df.withColumn("_ts", ts), start, end, "_ts").orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out.drop("_ts")


def read_portal_json(spark: SparkSession, path: str, start: str, end: str, limit: int | None = None,
                     schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return portal_records(reader.json(path), start, end, limit)


def unified_events(events: DataFrame | None = None, closures: DataFrame | None = None,
                   permits: DataFrame | None = None, crime: DataFrame | None = None) -> DataFrame:
    """S-13: one event table (date, event_type, name, district, source_dataset)."""
    parts = []
    if events is not None:
        parts.append(events.select(F.col("event_date").alias("date"), F.lit("event").alias("event_type"), "name",
                                   F.lit("events").alias("source_dataset")))
    if closures is not None:
        parts.append(closures.select(F.col("closure_date").alias("date"), F.lit("street_closure").alias("event_type"),
                                     "name", F.lit("closures").alias("source_dataset")))
    if permits is not None:
        parts.append(permits.select("date", "event_type", "name", F.lit("permits").alias("source_dataset")))
    if crime is not None:
        parts.append(crime.select("date", F.lit("crime").alias("event_type"), "district",
                                  F.lit("crime").alias("source_dataset")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

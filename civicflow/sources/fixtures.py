"""Views that map the landed benchmark tables onto the service-request model.

Each view is plain arithmetic on keys (see FIXTURES.md), so the same
definition runs on Spark and on the SQL oracle. All views are lazy
DataFrames: nothing here triggers a job.

Timestamps stay TIMESTAMP_NTZ (naive wall clock, like the source files);
streaming jobs convert to TIMESTAMP where a watermark needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DISTRICT_NAMES
from .tables import read_table

# Ordered columns of a clean request row (FIXTURES.md §1 "clean requests").
REQUEST_COLUMNS = ["case_id", "opened", "closed", "category", "status", "district",
                   "latitude", "longitude", "address", "resolution_hours"]


def _resolution(df: DataFrame) -> DataFrame:
    """resolution_hours from exact microseconds (sub-second safe)."""
    return df.withColumn(
        "resolution_hours",
        F.expr("timestampdiff(MICROSECOND, opened, closed)") / F.lit(3.6e9),
    )


def requests_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 days of sub-day requests from ``events`` (hourly/geo/resolution/stream questions)."""
    return requests_from_events(read_table(spark, sf_dir, "events"))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """The ``requests_short`` mapping over any ``events`` frame, batch or streaming."""
    opened = F.col("ts").cast("timestamp_ntz")
    closed = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("SECOND", F.round(F.col("value") * 3600).cast("int"), opened))
    district = F.when(F.col("user_id") % 13 == 0, F.lit(None)).otherwise(F.col("user_id") % 11 + 1)
    df = ev.select(
        F.col("event_id").cast("string").alias("case_id"),
        opened.alias("opened"),
        closed.alias("closed"),
        F.col("event_type").alias("category"),
        F.lit(None).cast("string").alias("status"),
        district.cast("int").alias("district"),
        (F.lit(37.4) + (F.col("event_id") * 7919 % 7000) / F.lit(10000.0)).alias("latitude"),
        (F.lit(-123.1) + (F.col("event_id") * 104729 % 12000) / F.lit(10000.0)).alias("longitude"),
        F.lit(None).cast("string").alias("address"),
    )
    return _resolution(df)


def first_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min(l_shipdate) per order: a partial (map-side) aggregate keyed by order."""
    return (read_table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("first_ship")))


def requests_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """~6.5 years of daily requests from ``orders`` (routing, trends, forecasts)."""
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ship = first_ship(spark, sf_dir)
    df = (orders
          .join(ship, orders.o_orderkey == ship.l_orderkey, "left")
          .join(cust, orders.o_custkey == cust.c_custkey, "left"))
    district = F.when(F.col("c_nationkey") == 0, F.lit(None)).otherwise(F.col("c_nationkey"))
    df = df.select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("opened"),
        F.col("first_ship").cast("timestamp_ntz").alias("closed"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("status"),
        district.cast("int").alias("district"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("string").alias("address"),
    )
    return _resolution(df)


def _lineitem_part(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    part = read_table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def event_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw community events: event_start_date (the Saturday of the ship week), event_name, seq keys.

    The three feeds keep every row and move its date, so that at any number of
    rows there are both days with and days without events (FIXTURES.md §2)."""
    return _lineitem_part(spark, sf_dir, "R").select(
        F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 5).alias("event_start_date"),
        F.col("p_name").alias("event_name"),
        "l_orderkey", "l_linenumber", "l_partkey")


def closure_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw street closures: start_date (the first of the ship month), case_name, street, seq keys."""
    return _lineitem_part(spark, sf_dir, "A").select(
        F.date_trunc("month", "l_shipdate").cast("date").alias("start_date"),
        F.col("p_name").alias("case_name"),
        F.col("p_type").alias("street"),
        "l_orderkey", "l_linenumber", "l_partkey")


def permit_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw construction permits: date (the Monday of the ship week), name, seq keys."""
    return _lineitem_part(spark, sf_dir, "N").select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("name"),
        "l_orderkey", "l_linenumber", "l_partkey")


def crime_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incidents: incident_date, supervisor_district (as text, like the portal)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").alias("incident_date"),
        (F.col("l_suppkey") % 11 + 1).cast("string").alias("supervisor_district"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct order date with deterministic weather values."""
    days = (read_table(spark, sf_dir, "orders")
            .select(F.to_date("o_orderdate").alias("date")).distinct())
    dn = F.datediff(F.col("date"), F.lit("1995-01-01").cast("date"))
    precip = (dn * 37 % 10) / F.lit(20.0)
    return days.select(
        "date",
        (F.lit(12.0) + (dn * 13 % 11) / F.lit(2.0)).alias("temp_max_c"),
        (F.lit(6.0) + (dn * 7 % 9) / F.lit(2.0)).alias("temp_min_c"),
        precip.alias("precip_mm"),
    ).withColumn("rain_day", (F.coalesce(F.col("precip_mm"), F.lit(0.0)) > 0.1).cast("int"))


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table built JVM-side (``inline`` of literal structs on one
    generated row), so no data is shipped from the Python driver."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def districts(spark: SparkSession) -> DataFrame:
    """The 11-row district dimension (size fixed by construction)."""
    return literal_table(spark, sorted(DISTRICT_NAMES.items()), ["district", "name"])


def portal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw portal-shaped request records derived from ``events`` (strings,
    GeoJSON point, junk district values) to exercise the normalisers."""
    ev = read_table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    closed = F.timestamp_add("SECOND", F.round(F.col("value") * 3600).cast("int"), ts)
    lat = F.lit(37.4) + (F.col("event_id") * 7919 % 7000) / F.lit(10000.0)
    lon = F.lit(-123.1) + (F.col("event_id") * 104729 % 12000) / F.lit(10000.0)
    district = (F.when(F.col("user_id") % 13 == 0, F.lit(None).cast("string"))
                .when(F.col("event_id") % 19 == 0, F.lit("abc"))
                .otherwise((F.col("user_id") % 11 + 1).cast("string")))
    point = F.when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return ev.select(
        F.col("event_id").cast("string").alias("service_request_id"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("requested_datetime"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format(closed, "yyyy-MM-dd HH:mm:ss")).alias("closed_date"),
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
        .alias("service_name"),
        F.when(F.col("event_id") % 10 == 0, F.lit("Open")).otherwise(F.lit("Closed")).alias("status_description"),
        F.concat((F.col("event_id") % 1000).cast("string"), F.lit(" Main St")).alias("address"),
        district.alias("supervisor_district"),
        point.alias("point"))

"""Request cleaning: P-01 rollup normaliser, P-02 fetch-time cleaner,
P-15 sanitising, P-16 / W-07 recent rows, P-17 load projection.

Which source column feeds which clean column is decided from ``df.columns``
(metadata, on the driver); all value conversions are JVM expressions.
Unparsable values become null (``try_cast``) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, tasks_for
from pyspark.sql import types as T

from ..functions.calendar import calendar_features
from ..functions.numeric import clean_double

# --- fixed values: column names tried in order, and the columns of a load ----
COORD_PAIRS = [("lat", "long"), ("lat", "lon")]
ID_COLUMNS = ["case_id", "service_request_id", "caseid"]
STATUS_COLUMNS = ["status", "status_description"]
LOAD_COLUMNS = ["opened", "closed", "category", "supervisor_district", "neighborhood", "latitude", "longitude",
                "resolution_hours", "year", "month", "day", "hour", "day_of_week", "week_of_year"]
MOST_RECENT_ROWS = 1000
BLOCK_BITS = 12              # numbered copies: 4,096 places of a written partition are one block


def to_ts(df: DataFrame, name: str) -> Column:
    """Column ``name`` as TIMESTAMP_NTZ; strings parsed leniently (bad -> null)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    return c.cast("string").try_cast("timestamp_ntz")


def to_num(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string").try_cast("double")


def _point(i: int) -> Column:
    """coordinates[i] of a GeoJSON point struct (1-based; [lon, lat]); null-safe."""
    return F.try_element_at(F.col("point.coordinates"), F.lit(i)).cast("double")


def _coords(df: DataFrame, allow_existing: bool) -> DataFrame:
    cols = set(df.columns)
    for la, lo in COORD_PAIRS:
        if la in cols and lo in cols:
            return df.withColumns({"latitude": to_num(df, la), "longitude": to_num(df, lo)})
    if "point" in cols:
        return df.withColumns({"latitude": _point(2), "longitude": _point(1)})
    if allow_existing and "latitude" in cols and "longitude" in cols:
        return df.withColumns({"latitude": to_num(df, "latitude"), "longitude": to_num(df, "longitude")})
    return df.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})


def _resolution(df: DataFrame) -> DataFrame:
    if "closed" not in df.columns:
        return df.withColumn("resolution_hours", F.lit(None).cast("double"))
    return df.withColumn("resolution_hours",
                         F.expr("timestampdiff(MICROSECOND, opened, closed)") / F.lit(3.6e9))


def normalize_requests(df: DataFrame) -> DataFrame:
    """P-01: clean request rows for rollups; rows without a parsable ``opened`` are dropped."""
    cols = set(df.columns)
    if "opened" in cols:
        df = df.withColumn("opened", to_ts(df, "opened"))
    elif "requested_datetime" in cols:
        df = df.withColumn("opened", to_ts(df, "requested_datetime"))
    else:
        raise ValueError("request rows need an opened or requested_datetime column")
    df = df.where(F.col("opened").isNotNull())
    df = _coords(df, allow_existing=True)
    if "category" in cols:
        df = df.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("Unknown")))
    elif "service_name" in cols:
        df = df.withColumn("category", F.coalesce(F.col("service_name").cast("string"), F.lit("Unknown")))
    else:
        df = df.withColumn("category", F.lit("Unknown"))
    if "supervisor_district" in cols:
        df = df.withColumn("district", to_num(df, "supervisor_district").try_cast("int"))
    elif "district" in cols:
        df = df.withColumn("district", to_num(df, "district").try_cast("int"))
    else:
        df = df.withColumn("district", F.lit(None).cast("int"))
    if "closed" in cols:
        df = df.withColumn("closed", to_ts(df, "closed"))
    elif "closed_date" in cols:
        df = df.withColumn("closed", to_ts(df, "closed_date"))
    return _resolution(df)


def clean_fetched(df: DataFrame) -> DataFrame:
    """P-02: fetch-time cleaner. Keeps rows whose ``opened`` is null, lets
    ``service_name`` win over ``category`` and adds calendar columns (P-03)."""
    cols = set(df.columns)
    if "requested_datetime" in cols:
        df = df.withColumn("opened", to_ts(df, "requested_datetime"))
    elif "opened" in cols:
        df = df.withColumn("opened", to_ts(df, "opened"))
    if "closed_date" in cols:
        df = df.withColumn("closed", to_ts(df, "closed_date"))
    df = calendar_features(df, "opened").drop("quarter", "is_weekend")
    if "service_name" in cols:
        df = df.withColumn("category", F.coalesce(F.col("service_name").cast("string"), F.lit("Unknown")))
    elif "category" in cols:
        df = df.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("Unknown")))
    else:
        df = df.withColumn("category", F.lit("Unknown"))
    if "point" in cols:
        df = df.withColumns({"latitude": _point(2), "longitude": _point(1)})
    if "supervisor_district" in cols:
        df = df.withColumn("supervisor_district", to_num(df, "supervisor_district"))
    if "closed" in df.columns:
        df = _resolution(df)
    return df


def sanitize(df: DataFrame) -> DataFrame:
    """P-15: NaN / infinity -> null in every floating column."""
    fl = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean_double(c) for c in fl}) if fl else df


def recent_rows(req: DataFrame, limit: int = 100) -> DataFrame:
    """W-07 + P-16: the ``limit`` (1..1000) newest rows, projected for display.

    ``orderBy(...).limit`` plans as TakeOrderedAndProject: every task keeps its
    own newest ``limit`` rows, so at most ``limit`` x tasks rows move.
    """
    if not 1 <= int(limit) <= MOST_RECENT_ROWS:
        raise ValueError(f"limit must be between 1 and {MOST_RECENT_ROWS}")
    id_col = next((c for c in ID_COLUMNS if c in req.columns), None)
    status_col = next((c for c in STATUS_COLUMNS if c in req.columns), None)
    top = req.orderBy(F.desc("opened"), *([F.desc(id_col)] if id_col else [])).limit(int(limit))

    def text(name: str | None, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in req.columns else F.lit(default)

    district_src = "district" if "district" in req.columns else "supervisor_district"
    return top.select(
        text(id_col, "N/A").alias("id"), text("category", "Unknown").alias("category"),
        text(status_col, "Unknown").alias("status"), "opened", "closed", text("address", "N/A").alias("address"),
        F.col(district_src).cast("string").try_cast("double").try_cast("int").alias("district"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))


def numbered_copies(df: DataFrame) -> DataFrame:
    """``row`` (all columns as a struct), ``hash`` of its content and ``copy``, a running number from 1 among equal rows.

    The rows are written once with their place, so that a retried task sees the same places. Places are cut into
    blocks; a row's number is its rank among the equal rows of its block, after those of the blocks before. So
    a table of equal rows is dealt by blocks, and a task sorts about ``ROWS_PER_TASK`` rows whatever the input: their
    number, not their shuffled size, sets the tasks, as equal rows shrink to next to nothing in a shuffle and
    would be put into few tasks. For the same reason the starts of the blocks are merged and never broadcast."""
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = materialize(df.select(F.struct("*").alias("row"), F.sha2(every, 256).alias("hash"),
                                 F.monotonically_increasing_id().alias("place")))
    rows, tasks = rows.withColumn("block", F.shiftrightunsigned("place", BLOCK_BITS)), tasks_for(rows)
    before = Window.partitionBy("hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("hash", "block").count().withColumn("start", F.sum("count").over(before)).where(
        "start > 0").drop("count").repartition(tasks, "hash", "block")
    place = F.struct("place", "row")
    lists = rows.repartition(tasks, "hash", "block").groupBy("hash", "block").agg(F.array_sort(
        F.collect_list(place), lambda x, y: F.signum(x["place"] - y["place"]).cast("int")).alias("list"))
    return lists.join(starts.hint("merge"), ["hash", "block"], "left").select(
        "hash", "start", F.posexplode("list").alias("at", "x")).select(
        "x.row", "hash", (F.coalesce("start", F.lit(0)) + F.col("at") + 1).alias("copy"))


def load_projection(df: DataFrame) -> DataFrame:
    """P-17: the known warehouse columns present in ``df`` plus ``case_id``.

    ``case_id`` falls back to ``caseid``, else to the SHA-256 of the row's content
    and, among equal rows, a running number -- deterministic under task retries,
    unlike a row index, and different for every row.
    """
    cols = set(df.columns)
    if "case_id" in cols:
        cid = F.col("case_id").cast("string")
    elif "caseid" in cols:
        cid = F.col("caseid").cast("string")
    else:
        df = numbered_copies(df)
        cid = F.concat_ws("-", F.col("hash"), F.col("copy").cast("string"))
        df = df.select("row.*", cid.alias("case_id"))
        cid = F.col("case_id")
    keep = [c for c in LOAD_COLUMNS if c in cols]
    out = df.select(*keep, cid.alias("case_id"))
    for t in ("opened", "closed"):
        if t in keep:
            out = out.withColumn(t, to_ts(out, t))
    return out

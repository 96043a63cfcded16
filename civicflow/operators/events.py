"""Side-table rollups: A-08 daily event counts, A-09 event names per date,
A-10 crime counts.

A-09 never gathers a date's rows in one place: names are first de-duplicated
per (date, name) by a partial aggregate keeping the earliest position, then
``row_number() <= 8`` per date runs as a WindowGroupLimit that keeps at most 8
rows per date in every map task before the shuffle. Only those <= 8 names
per date are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CLOSURE_NAME_MAX, CONSTRUCTION_PREFIX, ELLIPSIS, EVENT_NAME_MAX, NAME_CUT,
                         NAMES_PER_DATE)


def events_agg(events: DataFrame | None, closures: DataFrame | None, permits: DataFrame | None) -> DataFrame:
    """A-08: date, event_count, street_closure_count, construction_count (null dates dropped)."""
    parts = []
    if events is not None:
        parts.append(events.select(F.col("event_date").alias("date"), F.lit(0).alias("src")))
    if closures is not None:
        parts.append(closures.select(F.col("closure_date").alias("date"), F.lit(1).alias("src")))
    if permits is not None:
        parts.append(permits.select("date", F.lit(2).alias("src")))
    tagged = parts[0]
    for p in parts[1:]:
        tagged = tagged.unionByName(p)
    tagged = tagged.where(F.col("date").isNotNull())
    return tagged.groupBy("date").agg(
        F.sum((F.col("src") == 0).cast("long")).alias("event_count"),
        F.sum((F.col("src") == 1).cast("long")).alias("street_closure_count"),
        F.sum((F.col("src") == 2).cast("long")).alias("construction_count"))


def _event_names(events: DataFrame) -> DataFrame:
    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    return events.where(F.col("event_date").isNotNull()).select(
        F.col("event_date").alias("date"), name.alias("name"), F.lit(0).alias("src"), "seq").where(
        (F.col("name") != "") & (F.length("name") < EVENT_NAME_MAX))


def _closure_names(closures: DataFrame) -> DataFrame:
    base = F.trim(F.coalesce(F.col("name"), F.lit("")))
    with_street = F.when(base != "", F.trim(F.concat(base, F.lit(" ("), F.col("street"), F.lit(")")))).otherwise(
        F.col("street"))
    name = F.when(F.col("street").isNotNull(), with_street).otherwise(base)
    return closures.where(F.col("closure_date").isNotNull()).select(
        F.col("closure_date").alias("date"), name.alias("name"), F.lit(1).alias("src"), "seq").where(
        (F.col("name") != "") & (F.length("name") < CLOSURE_NAME_MAX))


def _permit_names(permits: DataFrame) -> DataFrame:
    name = F.left(F.concat(F.lit(CONSTRUCTION_PREFIX), F.trim(F.col("name"))), F.lit(NAME_CUT))
    return permits.where(F.col("date").isNotNull() & F.col("name").isNotNull()).select(
        "date", name.alias("name"), F.lit(2).alias("src"), "seq")


def event_name_candidates(events: DataFrame | None, closures: DataFrame | None,
                          permits: DataFrame | None) -> DataFrame:
    """Tagged, filtered, display-cut names: date, name, ord = (src, seq)."""
    parts = []
    if events is not None:
        parts.append(_event_names(events))
    if closures is not None:
        parts.append(_closure_names(closures))
    if permits is not None:
        parts.append(_permit_names(permits))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    shown = F.when(F.length("name") > NAME_CUT, F.concat(F.left("name", F.lit(NAME_CUT)), F.lit(ELLIPSIS))).otherwise(
        F.col("name"))
    return out.select("date", shown.alias("name"), F.struct("src", "seq").alias("ord"))


def events_by_date(events: DataFrame | None, closures: DataFrame | None, permits: DataFrame | None,
                   per_date: int = NAMES_PER_DATE) -> DataFrame:
    """A-09: date, event_names (first ``per_date`` distinct names in source order, '|'-joined)."""
    cand = event_name_candidates(events, closures, permits)
    first = cand.groupBy("date", "name").agg(F.min("ord").alias("ord"))      # ordered de-dup, map-side
    rn = F.row_number().over(Window.partitionBy("date").orderBy("ord", "name"))     # names settle equal places
    top = first.withColumn("rn", rn).where(F.col("rn") <= per_date)          # WindowGroupLimit
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    return top.groupBy("date").agg(F.array_join(names, "|").alias("event_names"))


def names_list(by_date: DataFrame) -> DataFrame:
    """P-18: date, names: the trimmed, non-empty names of each date of A-09."""
    names = F.transform(F.split("event_names", r"\|"), lambda x: F.trim(x))
    return by_date.select("date", F.filter(names, lambda x: x != "").alias("names"))


def crime_agg(crime: DataFrame, by_district: bool = True) -> DataFrame:
    """A-10: date, district, count (district null for a citywide feed)."""
    df = crime.where(F.col("date").isNotNull())
    if by_district and "district" in df.columns:
        return df.groupBy("date", "district").agg(F.count(F.lit(1)).alias("count"))
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("count")).withColumn("district", F.lit(None).cast("int"))


def crime_daily(crime_rollup: DataFrame) -> DataFrame:
    """Citywide incidents per day (sum over districts)."""
    return crime_rollup.groupBy("date").agg(F.sum("count").cast("long").alias("incident_count"))

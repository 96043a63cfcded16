"""Final ordering of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """Order a result that is small by construction -- one row per day, hour,
    weekday, month, category or district -- inside a single partition.

    A global ``orderBy`` would first run a sampling job to range-partition a
    few hundred rows. Only use this after an aggregate. ``repartition(1)`` puts
    an exchange behind it, so the final aggregate stays distributed (with
    ``coalesce(1)`` one task would merge the partial rows of every map task)."""
    return df.repartition(1).sortWithinPartitions(*cols)

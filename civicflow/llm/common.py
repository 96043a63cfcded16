"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.session import materialize

T = TypeVar("T")
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: computed once,
    read many times, and not recomputed when an executor is lost."""
    return materialize(df)


def fold(id_col: str, parts: int) -> Column:
    """crc32(id as text) mod ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def n_words(text_col: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not among ``columns``."""
    while name in columns:
        name += "_"
    return name


def slot(buckets: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str, *, most: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of about ``most`` labelled, ``usable`` rows at any corpus size (all, if
    fewer), written once. Chosen by a hash of the id on both sides, so that neither
    more labels nor more texts than the sample's reach the join. Null labels and
    texts count as unlabelled and empty; a label given twice counts twice."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
    share = min(1.0, most / max(1, known.count()))
    low = F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("long")), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = known.where(low).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label"))
    texts = docs.where(low).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return written(texts.join(chosen, "_id").select("text", "label"))


def worker_state(key: str, make: Callable[[], T]) -> T:
    """A value kept for the life of the Python worker process, so that a cache serves
    all tasks that the worker runs. (Functions sent by value bring their own
    module globals with every task.)"""
    state = sys.modules.setdefault("_civicflow_worker_state", types.ModuleType("_civicflow_worker_state"))
    if key not in vars(state):
        setattr(state, key, make())
    return getattr(state, key)

"""Exact duplicates by progressive refinement (DataFrame functions only).

Texts are equal when they are identical after deleting white space. Rows are
grouped by the length of what is left, then by a hash of its first bytes, and
only rows whose (length, prefix) group has company are read and hashed in full.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slot, written


def normalised(text_col: str = "text") -> Column:
    """The compared form of a text: null is empty, white space is deleted."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WHITE}+", "")


def _survivors(groups: DataFrame, slots: int, *keys: str) -> DataFrame:
    """Slots hit by at least one surviving group: at most ``slots`` rows of one
    long whatever the corpus size, so the broadcast has a fixed bound. A slot
    hit by chance only costs a needless hash, never a wrong result."""
    return F.broadcast(groups.select(slot(slots, *keys).alias("_slot")).distinct())


def progressive_exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                            prefix_chars: int = 64, slots: int = 1 << 18,
                            carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` and the ``carry`` columns.

    Of equal texts the row with the most code points in its original text stays,
    then the one with the smallest id. ``carry`` names columns computed from
    ``docs`` while its rows are read anyway.

    Exactly one row of a group is kept. Null and empty texts are equal to each other. A
    null id sorts after every other id; of rows that agree in size and id one stays, picked by
    a hash of the text, then by its place in the table. Other columns of ``docs`` are not
    looked at. An empty table gives no rows.
    """
    carry = dict(carry or {})
    norm = normalised(text_col)
    size, prefix = F.octet_length(norm), F.xxhash64(F.substring(norm, 1, prefix_chars))

    # levels 1 and 2 work on two numbers per row
    heads = written(docs.select(size.alias("_n"), prefix.alias("_p")))
    lengths = heads.groupBy("_n").count().where("count > 1")
    same_length = heads.withColumn("_slot", slot(slots, "_n")).join(
        _survivors(lengths, slots, "_n"), "_slot", "left_semi")
    prefixes = same_length.groupBy("_n", "_p").count().where("count > 1")

    # level 3 hashes the whole text, but only of rows in a surviving (length, prefix) group
    own = docs.select(F.col(id_col).alias("_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_cp"),
                      F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"),
                      norm.alias("_norm"), size.alias("_n"), prefix.alias("_p"),
                      *[c.alias(f"_carry_{k}") for k, c in carry.items()]).withColumn("_slot", slot(slots, "_n", "_p"))
    marked = own.join(_survivors(prefixes, slots, "_n", "_p").withColumn("_hit", F.lit(True)), "_slot", "left")
    rows = written(marked.select(
        "_id", "_cp", "_th", F.monotonically_increasing_id().alias("_row"),
        F.when(F.col("_hit"), F.sha2(F.col("_norm"), 256)).alias("_hash"),
        *[f"_carry_{k}" for k in carry]))

    best = F.min(F.struct((-F.col("_cp")).alias("cp"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                          F.col("_th").alias("th"), F.col("_row").alias("row")))
    groups = written(rows.where("_hash IS NOT NULL").groupBy("_hash")
                     .agg(F.count("*").alias("group_size"), best.alias("_best"))
                     .where("group_size > 1")
                     .select("_hash", "group_size", F.col("_best.id").alias("keep_id"), F.col("_best.row").alias("_keep")))

    alone = rows.where("_hash IS NULL").select(
        "*", F.lit(1).cast("long").alias("group_size"), F.col("_id").alias("keep_id"), F.col("_row").alias("_keep"))
    hashed = rows.where("_hash IS NOT NULL").join(groups, "_hash", "left").withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")),
        "_keep": F.coalesce("_keep", "_row"),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return alone.unionByName(hashed).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_row") == F.col("_keep")).alias("kept"),
        *[F.col(f"_carry_{k}").alias(k) for k in carry])

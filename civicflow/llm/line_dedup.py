"""Line dedup: repeated runs of lines from a suffix array over line ids.

Lines become ids, and a document the sequence of its lines' ids. The suffixes
of all sequences are ordered by prefix doubling: the rank of a suffix by its
first 2**(j+1) lines comes from the pair of ranks by 2**j lines at its start
and 2**j lines further on; all pairs are range-sorted and numbered in order.
Suffixes with the same first lines are neighbours in that order, so an interval
of the array with a common prefix is a repeated run with all its copies.

A run matters from ``min_words`` words on. A line is deleted when it lies in a
run of that size that occurs earlier (in an earlier document by id, or further
up in the same document without overlap). Every such run is covered by its
minimal windows: from each line onward, and from each line backward, the fewest
lines that reach ``min_words``. So only the intervals at those prefixes are
needed; they are at most ``min_words`` lines long, which bounds the doublings at
log2(min_words), and the ranks of a window's first and last 2**j lines name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WORD, written

DOC = ["_id", "_th"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's key: its id and a hash of its text."""
    return F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th")


def _ordered_ids(keys: DataFrame, name: str, *cols: str) -> DataFrame:
    """``keys`` with a number in the order of ``cols``, from 1: range partitions in
    order, and each partition's rows in order."""
    ordered = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return written(ordered.select(*cols, (F.monotonically_increasing_id() + 1).alias(name)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, line, k, digest, words) of every line that is not blank; ``k``
    counts those. Lines are compared without white space at their ends."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    trimmed = F.transform(split, lambda x, i: F.struct(
        i.alias("line"), F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "").alias("t")))
    found = F.posexplode(F.filter(trimmed, lambda x: x["t"] != "")).alias("k", "x")
    return docs.select(*_documents(docs, id_col, text_col), found).select(
        *DOC, F.col("x.line").alias("line"), "k", F.unhex(F.md5("x.t")).alias("digest"),
        F.regexp_count("x.t", F.lit(WORD)).alias("words"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur more than once, with their ids ``r0``, in stretches of
    consecutive such lines (``part``) that have ``min_words`` words at least. Rows
    that share id and text are one document, so each of its lines stays once."""
    repeated = lines.groupBy("digest").count().where("count > 1").select("digest")
    ids = _ordered_ids(repeated, "r0", "digest")
    own = lines.join(ids, "digest").select(*DOC, "line", "k", "words", "r0").distinct()
    doc = Window.partitionBy(*DOC).orderBy("k", "line")
    part = Window.partitionBy(*DOC, "part")
    return written(own.withColumn("part", F.col("k") - F.row_number().over(doc))
                   .withColumn("sum", F.sum("words").over(part)).where(F.col("sum") >= min_words).drop("sum"))


def _doubled(rows: DataFrame, j: int) -> DataFrame | None:
    """``rows`` with ``r{j+1}``: the ordered id of the first 2**(j+1) lines, null
    where they are not all there or occur once. None when no such run repeats."""
    at = Window.partitionBy(*DOC, "part").orderBy("k")
    pairs = rows.withColumn("_next", F.lead(f"r{j}", 1 << j).over(at))
    repeated = (pairs.where(f"r{j} IS NOT NULL AND _next IS NOT NULL")
                .groupBy(f"r{j}", "_next").count().where("count > 1").drop("count"))
    ids = _ordered_ids(repeated, f"r{j + 1}", f"r{j}", "_next")
    if ids.isEmpty():
        return None
    return written(pairs.join(ids, [f"r{j}", "_next"], "left").drop("_next"))


def _reach(words: Column, min_words: int) -> Column:
    """How many leading items of an array of word counts it takes to reach ``min_words``; null if all don't."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    done = F.aggregate(words, start, lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(
        F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))))
    return F.when(done["sum"] >= min_words, done["n"])


def _windows(rows: DataFrame, levels: int, min_words: int) -> DataFrame:
    """Minimal windows (doc, start, len) with the name (len, a, b): ranks of their first and last 2**j lines."""
    at = Window.partitionBy(*DOC, "part").orderBy("k")
    ahead = F.collect_list("words").over(at.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(at.rowsBetween(1 - min_words, 0)))
    sized = rows.withColumn("fwd", _reach(ahead, min_words)).withColumn("bwd", _reach(behind, min_words))
    none = F.lit(None).cast("long")
    fa, fb, ba, bb = none, none, none, none

    def shifted(j: int, low: int, high: int) -> Column:
        """r_j of the rows low..high away; 0 stands for a missing rank so that places are kept."""
        return F.collect_list(F.coalesce(f"r{j}", F.lit(0))).over(at.rowsBetween(low, high))

    for j in range(levels + 1):
        span = 1 << j
        here = F.col(f"r{j}")
        f_in = (F.col("fwd") >= span) & (F.col("fwd") < 2 * span)
        b_in = (F.col("bwd") >= span) & (F.col("bwd") < 2 * span)
        fa = F.when(f_in, here).otherwise(fa)
        fb = F.when(f_in, F.get(shifted(j, 0, span - 1), F.col("fwd") - span)).otherwise(fb)
        bb = F.when(b_in, F.lag(f"r{j}", span - 1).over(at)).otherwise(bb)
        # the window starts bwd - 1 rows back, that is bwd - span before the row span - 1 back
        ba = F.when(b_in, F.get(F.reverse(shifted(j, 2 - 2 * span, 1 - span)), F.col("bwd") - span)).otherwise(ba)
    named = sized.select(
        *DOC, "k", "fwd", "bwd", fa.alias("fa"), fb.alias("fb"), ba.alias("ba"), bb.alias("bb"))
    either = F.explode(F.array(
        F.struct(F.col("k").alias("start"), F.col("fwd").alias("len"), F.col("fa").alias("a"), F.col("fb").alias("b")),
        F.struct((F.col("k") - F.col("bwd") + 1).alias("start"), F.col("bwd").alias("len"),
                 F.col("ba").alias("a"), F.col("bb").alias("b")))).alias("w")
    return written(named.select(*DOC, either).select(*DOC, "w.*").where("len IS NOT NULL AND a > 0 AND b > 0").distinct())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> DataFrame:
    """(_id, _th, start, len): windows to delete, in lines that are not blank."""
    lines = written(_lines(docs, id_col, text_col))
    rows, levels = _stretches(lines, min_words), 0
    while 2 << levels <= min_words:
        more = _doubled(rows, levels)
        if more is None:
            break
        rows, levels = more, levels + 1
    windows = _windows(rows, levels, min_words)
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_th").alias("th"),
                     F.col("start").alias("at"))
    first = written(windows.groupBy("len", "a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first"))
                    .where("n > 1").drop("n"))
    same_doc = F.col("first.id").eqNullSafe(F.col("_id")) & (F.col("first.th") == F.col("_th"))
    later = (F.col("first") < place) & (~same_doc | (F.col("first.at") + F.col("len") <= F.col("start")))
    return windows.join(first, ["len", "a", "b"]).where(later).select(*DOC, "start", "len")


def _cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts, lens in parts:
        out, gone = [], []
        for text, first, length in zip(texts, starts, lens):
            if first is None:                        # nothing to cut: the text was not even sent
                out.append(None)
                gone.append([])
                continue
            lines = (text or "").split("\n")
            full = np.array([k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")], np.int64)
            hit = np.zeros(len(full) + 1, np.int64)
            np.add.at(hit, np.asarray(first, np.int64), 1)
            np.add.at(hit, np.asarray(first, np.int64) + np.asarray(length, np.int64), -1)
            drop = full[np.cumsum(hit)[:-1] > 0]
            keep = np.ones(len(lines), bool)
            keep[drop] = False
            out.append("\n".join(x for x, k in zip(lines, keep) if k))
            gone.append(drop.astype(np.int32))
        yield pd.DataFrame({"text": out, "removed": gone})


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                        min_words: int = 50, removed_col: str = "removed_lines") -> DataFrame:
    """``docs`` with ``text_col`` less its repeated lines, and ``removed_col``:
    the numbers (from 0) of the lines that went, an empty array for most rows.

    All columns and rows are kept, whatever the columns are called, texts without a repeated run unchanged (null
    stays null). Blank lines are not part of a run and stay. The first copy by
    id stays; documents without an id count as last. Rows that share id and text
    are one document and lose the same lines. A document whose every line
    occurred before ends with an empty text (and its blank lines).
    """
    runs = (repeated_runs(docs, id_col, text_col, min_words=min_words)
            .groupBy(*DOC).agg(F.collect_list("start").alias("_starts"), F.collect_list("len").alias("_lens")))
    runs = written(runs).withColumnsRenamed({"_id": "_run_id", "_th": "_run_th"})
    own = docs.select(F.struct("*").alias("_doc"), *_documents(docs, id_col, text_col), F.col(text_col).alias("_text"))
    # the runs grow with the corpus: a sort-merge join at any size, over which the texts move once
    joined = own.join(runs.hint("merge"), F.col("_id").eqNullSafe(F.col("_run_id")) & (F.col("_th") == F.col("_run_th")), "left")
    hit = F.col("_starts").isNotNull()
    cut_lines = F.pandas_udf(_cut, "text string, removed array<int>")
    cut = joined.select("_doc", "_text", hit.alias("_hit"), cut_lines(F.when(hit, F.col("_text")), "_starts", "_lens").alias("_cut"))
    text = F.when(F.col("_hit"), F.col("_cut.text")).otherwise(F.col("_text"))
    return cut.select(*[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns],
                      F.col("_cut.removed").alias(removed_col))

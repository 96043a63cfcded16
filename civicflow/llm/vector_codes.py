"""Vector code compression: a codebook per part, refined with adaptive distance bounds.

Every vector is cut into parts; a part's code is the number of its codebook's nearest
entry. Between rounds each part keeps its closest entries with ordered lower bounds on
their distances, an upper bound on the distance of its own entry and one outer lower bound
for all other entries (Drake and Hamerly). After entries have moved, the bounds move
with them, and only parts whose bounds overlap look at entries again: at as many of
the closest as overlap, or at all where the outer bound does. The number of entries kept
shrinks to what the last round needed.

Bounds are floating point and err to the safe side; wherever they don't decide, distances
are compared as integers, so the codes are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.session import Scratch

from .common import written

MOST = 1 << 27               # components beyond this could overflow a long in 64 squared differences


def _down(squared: np.ndarray) -> np.ndarray:
    """A lower bound on the root."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def _up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(n, dims) points, (n, m, dims) entries -> (n, m) exact squared distances."""
    return ((points[:, None, :] - entries) ** 2).sum(axis=2)


class Bounds:
    """State of the vectors of a batch for one part: ``near[:, 0]`` is the code, ``near[:, 1:]``
    other close entries; ``low[:, 0]`` is an upper bound on the code's distance, ``low[:, j]`` a
    lower bound on that of ``near[:, j]`` and all after it, the last one of all other entries."""

    def __init__(self, points: np.ndarray, book: np.ndarray, kept: int):
        self.points, self.book, self.kept = points, book, kept

    def fresh(self) -> None:
        n = len(self.points)
        self.near, self.low = np.zeros((n, self.kept + 1), np.uint8), np.zeros((n, self.kept + 2), np.float32)
        self._full(np.arange(n))
        self.needed = np.full(n, self.kept + 1)

    def _full(self, rows: np.ndarray) -> None:
        """All entries of ``rows`` in the order of (distance, number)."""
        d = _squared(self.points[rows], self.book[None])
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        self.near[rows] = order[:, :self.kept + 1]
        low = _down(d[:, :self.kept + 2])
        if low.shape[1] < self.kept + 2:              # no entry beyond the kept ones
            low = np.concatenate([low, np.full((len(rows), 1), np.inf, np.float32)], axis=1)
        low[:, 0] = _up(d[:, 0])
        self.low[rows] = low

    def moved(self, near: np.ndarray, low: np.ndarray, drift: np.ndarray) -> None:
        """Take over the last round's state after entries have moved by at most ``drift``."""
        self.near = near[:, :self.kept + 1].copy()
        moved = drift[near].astype(np.float32)
        low = low.copy()
        low[:, 0] = np.nextafter(low[:, 0] + moved[:, 0], np.float32(np.inf))
        low[:, 1:-1] = np.nextafter(low[:, 1:-1] - moved[:, 1:], np.float32(-np.inf))
        low[:, -1] = np.nextafter(low[:, -1] - drift.max(initial=0), np.float32(-np.inf))
        low[:, 1:] = np.minimum.accumulate(low[:, :0:-1], axis=1)[:, ::-1]          # ordered
        self.low = low[:, :self.kept + 2]             # a shorter list's last bound holds for what is left out
        self.needed = (self.low[:, 1:] <= self.low[:, :1]).sum(axis=1)
        rows = np.flatnonzero(self.needed)            # these overlap: tighten the upper bound first
        own = _squared(self.points[rows], self.book[self.near[rows, :1]])[:, 0]
        self.low[rows, 0] = _up(own)
        self.needed[rows] = (self.low[rows, 1:] <= self.low[rows, :1]).sum(axis=1)
        for m in range(1, self.kept + 1):
            self._some(np.flatnonzero(self.needed == m), m)
        self._full(np.flatnonzero(self.needed > self.kept))

    def _some(self, rows: np.ndarray, m: int) -> None:
        """Compare the code and the next ``m`` entries of ``rows`` as integers; no other can be as near."""
        if not len(rows):
            return
        near = np.sort(self.near[rows, :m + 1], axis=1)                              # ties go to the lower number
        d = _squared(self.points[rows], self.book[near])
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        self.near[rows, :m + 1] = np.take_along_axis(near, order, axis=1)
        low = self.low[rows]
        low[:, 1:m + 1] = np.minimum(_down(d[:, 1:]), low[:, m + 1:m + 2])           # still ordered
        low[:, 0] = _up(d[:, 0])
        self.low[rows] = low


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _round(rows: DataFrame, books: np.ndarray, drift: np.ndarray | None, kept: int, last_kept: int | None,
           exact_error: bool, extra: list[str]) -> DataFrame:
    """One pass over all vectors: new state, and one row per task with the sums of its parts by
    entry, their counts and how many entries the parts needed."""
    parts, entries, width = books.shape

    def batches(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        needs, empty = np.zeros(kept + 2, np.int64), None
        for part in batch_rows:
            empty = empty or part.slice(0, 0)
            n = part.num_rows
            points = _flat(part.column("q"), "<i4").reshape(n, parts, width).astype(np.int64)
            if drift is not None:
                near = _flat(part.column("near"), np.uint8).reshape(n, parts, last_kept + 1)
                low = _flat(part.column("low"), "<f4").reshape(n, parts, last_kept + 2)
            new_near, new_low = np.empty((n, parts, kept + 1), np.uint8), np.empty((n, parts, kept + 2), np.float32)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                state = Bounds(points[:, p], books[p], kept)
                if drift is None:
                    state.fresh()
                else:
                    state.moved(near[:, p], low[:, p], drift[p])
                code = state.near[:, 0]
                needs += np.bincount(state.needed, minlength=kept + 2)
                counts[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, points[:, p])
                if exact_error:
                    error += ((points[:, p] - books[p][code]) ** 2).sum(axis=1)
                new_near[:, p], new_low[:, p] = state.near, state.low
            yield pa.RecordBatch.from_arrays([
                *(part.column(c) for c in extra), part.column("q"),
                pa.array([x.tobytes() for x in new_near], pa.binary()), pa.array([x.tobytes() for x in new_low], pa.binary()),
                pa.array([x.tobytes() for x in np.ascontiguousarray(new_near[:, :, 0])], pa.binary()), pa.array(error),
                pa.nulls(n, pa.list_(pa.int64()))], names=[*extra, *NAMES])
        if empty is not None:
            total = np.concatenate([sums.ravel(), counts.ravel(), needs]).tolist()
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(1, empty.column(c).type) for c in extra), *(pa.nulls(1, pa.binary()) for _ in range(4)),
                pa.nulls(1, pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=[*extra, *NAMES])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(batches, f"{kinds}, q binary, near binary, low binary, code binary, error long, total array<long>")


NAMES = ["q", "near", "low", "code", "error", "total"]


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and needs of all tasks: as many numbers as the codebooks have, whatever the data."""
    parts, entries, width = shape
    rows = (state.where("total IS NOT NULL").select(F.posexplode("total").alias("k", "x"))
            .groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect())
    flat = [int(r["x"]) for r in rows]
    cut = parts * entries * width
    return (np.array(flat[:cut], object).reshape(shape), np.array(flat[cut:cut + parts * entries], object).reshape(parts, entries),
            np.array(flat[cut + parts * entries:], np.int64))


def quantised(vectors: DataFrame, vec_col: str, scale: int) -> tuple[F.Column, F.Column]:
    """(whether a vector takes part, its integer components)."""
    x = F.col(vec_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return F.coalesce(usable, F.lit(False)), F.transform(x, lambda v: F.floor(v.cast("double") * scale))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *,
                 scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6,
                 near: int = 4) -> tuple[DataFrame, np.ndarray]:
    """``(id_col, label_col, code, error, label_error)`` per usable vector, and the codebooks
    (parts, entries, components) as integers.

    ``code`` holds a byte per part, the number of the nearest entry (ties: the lower); ``error`` is
    the squared distance to the entries in all, ``label_error`` its sum over rows of the
    same label, null labels together. Codebooks start as the parts of the ``entries`` vectors
    with the smallest ids (fewer, if the table has fewer; null ids last, equal ids in the order of
    their components) and are refined ``rounds`` times by componentwise ``floor(mean)``; an entry
    that no part uses stays.

    Null vectors and those that hold null or non-finite components take no part, nor do vectors
    of another length than that of the smallest id's vector or where ``parts`` doesn't divide it.
    A component beyond 2**27 after scaling raises: sums of its squares leave the 64-bit range.
    Repeated rows are coded each on its own. Other columns are not looked at; an empty table gives
    no rows. ``near`` is the number of close entries kept at first.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    usable, components = quantised(vectors, vec_col, scale)
    own = vectors.where(usable).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"),
                                       components.alias("_q"))
    first = own.orderBy(F.col("_id").asc_nulls_last(), "_q").limit(entries).collect()
    size = len(first[0]["_q"]) if first else 0
    seeds = [r["_q"] for r in first if len(r["_q"]) == size]
    columns = [F.col("_id").alias(id_col), F.col("_label").alias(label_col)]
    if not seeds or size == 0 or size % parts:
        none = own.where("false").select(*columns, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"),
                                         F.lit(0).cast("long").alias("label_error"))
        return none, np.zeros((parts, 0, size // parts), np.int64)
    if len(seeds) < len(first):                       # other lengths among the first: look for those that fit
        seeds = [r["_q"] for r in own.where(F.size("_q") == size).orderBy(F.col("_id").asc_nulls_last(), "_q")
                 .limit(entries).collect()]
    largest = F.greatest(F.abs(F.array_max("_q")), F.abs(F.array_min("_q")))
    whole = F.when(largest > MOST, F.raise_error(F.lit(f"a component leaves +-{MOST} after scaling"))).otherwise(F.col("_q"))
    fits = own.where(F.size("_q") == size).select("_id", "_label", whole.cast("array<int>").alias("_q"))
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, size // parts).transpose(1, 0, 2)

    extra = ["_id", "_label"]
    with Scratch(vectors.sparkSession) as scratch:
        state = scratch.write(_packed_vectors(fits, extra))
        kept, last_kept, drift = max(0, min(near, books.shape[1] - 1)), None, None
        for turn in range(rounds + 1):
            last = turn == rounds
            after = _round(state.where("total IS NULL") if turn else state, books, drift, kept, last_kept, last, extra)
            if last:
                coded = written(after.where("total IS NULL").select("_id", "_label", "code", "error"))
                break
            after = scratch.write(after)
            scratch.drop(state)
            state = after
            sums, counts, needs = _totals(state, books.shape)
            new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books).astype(np.int64)
            drift, books, last_kept = _up(((new - books) ** 2).sum(axis=2)), new, kept
            if turn:                                   # entries that some part needed in this round, at least one
                kept = max(1, min(kept, int(np.flatnonzero(needs[:-1]).max(initial=0)))) if kept else 0
    by_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_l")
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_l")), "left")
    return out.select(*columns, "code", "error", "label_error"), books


def _packed_vectors(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Integer components as little-endian bytes, four each."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            q = [np.asarray(x.values, "<i4").tobytes() for x in part.column("_q")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array(q, pa.binary())], names=[*extra, "q"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(batches, f"{kinds}, q binary")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

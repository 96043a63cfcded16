"""Exact top-k inner products over a pivot-distance index.

Vectors are quantised to integers and given one more coordinate that brings all
of them to the length of the longest, so that the largest inner products with a
query are its nearest vectors. Each vector is keyed by its nearest pivot and its
distance to it; a pivot's vectors, sorted by distance and cut into rings, are its
annuli. By the triangle inequality the vectors of an annulus [low, high] lie at
least max(0, d - high, low - d) from a query at distance d from the pivot, which
bounds their inner products from above. Queries visit annuli in the order of
that bound, a few more each round, and stop where it falls below their k-th best
score so far. Pivots and ring edges come from a bounded sample; every vector is
indexed, and the result is exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PACK = 256                   # vectors in a row of the index


@dataclass
class Pivots:
    points: np.ndarray       # (pivots, dim + 1)
    edges: np.ndarray        # (pivots, rings - 1) distances
    longest: float           # squared length of the longest vector

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(n, dim + 1) -> (n, pivots)"""
        sq = (x * x).sum(axis=1)[:, None] + (self.points ** 2).sum(axis=1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(sq, 0))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring number over all pivots, and the distance to the pivot, of quantised vectors."""
        d = self.distances(self.lifted(x))
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(d)), pivot]
        ring = (near[:, None] > self.edges[pivot]).sum(axis=1)
        return pivot * (self.edges.shape[1] + 1) + ring, near


def fit_pivots(sample: np.ndarray, longest: float, n_pivots: int, rings: int, rounds: int = 8, seed: int = 9) -> Pivots:
    """Pivots are cluster means of the sample, ring edges its distance quantiles."""
    p = Pivots(np.zeros((0, 0)), np.zeros((0, 0)), longest)
    x = p.lifted(sample if len(sample) else np.zeros((1, sample.shape[1])))
    p.points = x[np.random.default_rng(seed).permutation(len(x))[:n_pivots]]
    for _ in range(rounds):
        own = p.distances(x).argmin(axis=1)
        p.points = np.stack([x[own == k].mean(axis=0) if (own == k).any() else p.points[k] for k in range(len(p.points))])
    d = p.distances(x)
    own, at = d.argmin(axis=1), np.linspace(0, 1, rings + 1)[1:-1]
    p.edges = np.stack([np.quantile(d[own == k, k], at) if (own == k).any() else np.zeros(rings - 1)
                        for k in range(len(p.points))])
    return p


def _usable(vector: str) -> Column:
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, v): floor(scale * x) as packed 32-bit integers, shorter vectors filled with zeros."""
    own = vectors.where(F.col(id_col).isNotNull()).where(_usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    dim = max(1, own.agg(F.max(F.size("x"))).first()[0] or 0)
    most = min((1 << 31) - 1, math.isqrt((1 << 62) // dim))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column("x")
            sizes, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy(zero_copy_only=False)
            full = np.zeros((len(x), dim), "<i4")
            where = np.arange(dim) < sizes[:, None]
            whole = np.floor(scale * flat)
            if np.abs(whole).max(initial=0) > most:
                raise OverflowError(f"a component leaves +-{most} after scaling: scores could leave the 64-bit range")
            full[where] = whole
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array([r.tobytes() for r in full], pa.binary())], names=["vec_id", "v"])

    return written(own.mapInArrow(batches, "vec_id long, v binary").distinct()), dim


def build_index(rows: DataFrame, dim: int, *, n_pivots: int, rings: int, sample_rows: int) -> tuple[DataFrame, Pivots]:
    """(ring, low, high, n, ids, vs): the annuli, up to PACK neighbours in distance to a row."""
    def squares(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("v"), dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array((x * x).sum(axis=1), pa.float64())], names=["sq"])

    longest = rows.mapInArrow(squares, "sq double").agg(F.max("sq")).first()[0] or 0.0
    picked = rows.orderBy(F.xxhash64("v"), "vec_id").limit(sample_rows).select("v").collect()
    pivots = fit_pivots(np.frombuffer(b"".join(bytes(r["v"]) for r in picked), "<i4").reshape(-1, dim),
                        longest, n_pivots, rings)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ring, near = pivots.keys(_matrix(part.column("v"), dim))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(ring.astype(np.int32)),
                                              pa.array(near)], names=["vec_id", "v", "ring", "near"])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ring, near = part.column("ring").to_numpy(), part.column("near").to_numpy()
            ids, vs = part.column("vec_id").to_numpy(), part.column("v")
            cuts = sorted({0, len(ring), *(np.flatnonzero(np.diff(ring)) + 1).tolist()})
            cuts = [(k, min(k + PACK, z)) for a, z in zip(cuts, cuts[1:]) for k in range(a, z, PACK)]
            out = [(int(ring[a]), float(near[a]), float(near[z - 1]), z - a, ids[a:z].astype("<i8").tobytes(),
                    b"".join(vs[a:z].to_pylist())) for a, z in cuts]
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.float64(), pa.int32(),
                                                           pa.binary(), pa.binary()))],
                names=["ring", "low", "high", "n", "ids", "vs"])

    order = ["ring", "near", "vec_id"]
    near = written(rows.mapInArrow(keyed, "vec_id long, v binary, ring int, near double"))
    index = near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        packed, "ring int, low double, high double, n int, ids binary, vs binary")
    return written(index), pivots


def _visits(queries: DataFrame, dim: int, pivots: Pivots, directory: list, seen: int, upto: int) -> DataFrame:
    """Query rows with the rings at places seen..upto of their order that may still hold a better score."""
    ring = np.array([d["ring"] for d in directory], np.int64)
    low, high = np.array([d["low"] for d in directory]), np.array([d["high"] for d in directory])
    pivot = ring // (pivots.edges.shape[1] + 1)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            q = _matrix(part.column("v"), dim).astype(np.float64)
            # a query's added coordinate is 0: its inner product with any vector is unchanged
            d = pivots.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))[:, pivot]
            apart = np.maximum(np.maximum(d - high, low - d), 0)
            sq = (q * q).sum(axis=1)[:, None]
            bound = (sq + pivots.longest - apart ** 2) / 2
            bound += 1e-9 * (sq + pivots.longest + d ** 2) + 1e-6           # rounding never hides an annulus
            order = np.argsort(-bound, axis=1, kind="stable")[:, seen:upto]
            floor = part.column("floor").to_numpy(zero_copy_only=False)
            take = np.take_along_axis(bound, order, axis=1) >= np.nan_to_num(floor.astype(np.float64), nan=-np.inf)[:, None]
            who, place = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([
                part.column(c).take(pa.array(who)) for c in ("query_id", "v", "floor")]
                + [pa.array(ring[order[who, place]].astype(np.int32))], names=["query_id", "v", "floor", "ring"])

    return queries.mapInArrow(batches, "query_id long, v binary, floor long, ring int")


def _scored(visits: DataFrame, index: DataFrame, dim: int, k: int, slots: int) -> DataFrame:
    """The k best of each visited index row per query, where not below the query's floor."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [np.zeros((0, 3), np.int64)]
            for queries, ids, vs in zip(part.column("queries"), part.column("ids"), part.column("vs")):
                rows = queries.values
                own = rows.field("query_id").to_numpy()
                floor = rows.field("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                q, x = _matrix(rows.field("v"), dim), np.frombuffer(vs.as_buffer(), "<i4").reshape(-1, dim)
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                small = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < (1 << 26) / np.sqrt(dim)
                kind = np.float64 if small else np.int64                   # float64 is exact below 2**53
                scores = (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)
                ok = (ids[None, :] != own[:, None]) & ~(scores < floor[:, None])
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, ~ok), axis=1)[:, :k]
                r, c = np.nonzero(np.take_along_axis(ok, order, axis=1))
                c = order[r, c]
                out.append(np.stack([own[r], ids[c], scores[r, c]], axis=1))
            got = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(3)],
                                             names=["query_id", "vec_id", "score"])

    packs = (visits.groupBy("ring", F.pmod(F.xxhash64("query_id"), F.lit(slots)).alias("slot"))
             .agg(F.collect_list(F.struct("query_id", "v", "floor")).alias("queries")))
    return packs.join(index, "ring").select("queries", "ids", "vs").mapInArrow(
        batches, "query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *,
                       k: int = 5, scale: int = 256, n_pivots: int = 32, rings: int = 16, sample_rows: int = 4096,
                       rounds: tuple[int, ...] = (4, 32)) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest integer inner product with
    each row that ``is_query`` picks (a condition on ``vec_id``), other than its own id; ties go to
    the smaller id, and rank runs from 1.

    Rows with a null id take no part, nor do vectors that are null or hold null
    or non-finite components. A shorter vector counts as filled up with zeros
    (an empty one as all zeros). Components so large that a score
    could leave the 64-bit range (beyond 2**28 after scaling in 64 dimensions) raise. Rows
    equal in id and vector count once. An empty table, or a single row, gives no
    rows. Other columns are not looked at.

    The first ``rounds`` visit so many annuli of a query's order; the last visits
    all that remain and may hold a better score, so nothing is cut off.
    """
    rows, dim = quantised(vectors, id_col, vector_col, scale)
    index, pivots = build_index(rows, dim, n_pivots=n_pivots, rings=rings, sample_rows=sample_rows)
    # at most n_pivots * rings entries
    directory = index.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("ring").collect()
    queries = written(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v"))
    slots = max(1, -(-queries.count() // PACK))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = rows.sparkSession.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"),
                                              F.col("id").alias("score"))
    seen = 0
    for upto in (*rounds, len(directory)):
        if seen < len(directory):
            floors = found.where("rank = %d" % k).select("query_id", F.col("score").alias("floor")) if seen else \
                found.select("query_id", F.col("score").alias("floor"))
            waiting = queries.join(floors, "query_id", "left")
            more = _scored(_visits(waiting, dim, pivots, directory, seen, upto), index, dim, k, slots)
            found = written(found.select("query_id", "vec_id", "score").unionByName(more)
                            .dropDuplicates(["query_id", "vec_id", "score"])
                            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
            seen = upto
    return found.select("query_id", F.col("rank").cast("int").alias("rank") if seen else F.lit(0).alias("rank"),
                        "vec_id", "score")

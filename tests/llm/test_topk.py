import math

import numpy as np
import pytest
from civicflow.llm.topk import fit_pivots, top_inner_products
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, query_id string"


def brute(rows, every, k):
    """Plain integers over all pairs."""
    dim = max([len(v) for _, v in rows], default=0)
    own = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v) + (0,) * (dim - len(v)))
           for i, v in rows if i is not None}
    out = set()
    for i, q in own:
        if i % every == 0:
            best = sorted({(-sum(a * b for a, b in zip(q, x)), j) for j, x in own if j != i})[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return sorted(out)


def result(df, every, **kw):
    return sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") % every == 0, **kw).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA)


def test_clusters_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] * (1 + k % 3) + rng.normal(0, 0.1, 8)]) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(120)]                  # a large group of equal vectors
    for pivots, rings, rounds in ((4, 3, (1, 2)), (1, 1, ()), (32, 16, (4, 32))):
        assert result(table(spark, rows), 20, n_pivots=pivots, rings=rings, rounds=rounds) == brute(rows, 20, 5)


def test_odd_rows(spark):
    good = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (1, [0.1]), (2, []), (3, [3.0, -7.5]), (3, [3.0, -7.5]), (100, [0.0, 0.0])]
    bad = [(4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (None, [9.0, 9.0]), (150, None)]
    assert result(table(spark, good + bad), 50) == brute(good, 50, 5)


def test_few_and_no_rows(spark):
    assert result(table(spark, []), 50) == []
    assert result(table(spark, [(0, [1.0])]), 50) == []
    assert result(table(spark, [(0, [1.0]), (1, [2.0])]), 50) == [(0, 1, 1, 256 * 512)]


def test_large_components_are_exact(spark):
    rows = [(k, [1000.0 * (-1) ** k * (k + 1), 3000.5 + k]) for k in range(40)]
    assert result(table(spark, rows), 10) == brute(rows, 10, 5)


def test_components_past_a_million_are_exact_or_raise(spark):
    rows = [(0, [3_000_000.0, 1.0]), (1, [3_000_000.0, 2.0]), (2, [3_000_000.5, -1.0]), (3, [-2.5e6, 7.0])]
    assert result(table(spark, rows), 10) == brute(rows, 10, 5)
    with pytest.raises(Exception, match="64-bit range"):
        result(table(spark, [(0, [1e9, 1.0]), (1, [1.0, 1.0])]), 10)


def test_bound_holds_for_every_vector():
    """The triangle inequality on lifted vectors: no score exceeds its annulus's bound."""
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (200, 6))
    longest = float((x.astype(float) ** 2).sum(axis=1).max())
    p = fit_pivots(x, longest, 5, 4)
    ring, near = p.keys(x)
    pivot = ring // 4
    for q in x[:20].astype(float):
        d = p.distances(np.concatenate([q, [0]])[None])[0]
        bound = (q @ q + longest - (d[pivot] - near) ** 2) / 2
        assert (x @ q <= bound + 1e-6).all()

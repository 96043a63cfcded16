import numpy as np
import pytest
from civicflow.llm import vector_codes as vc


def brute(vectors, parts, entries, rounds):
    """Codes, errors and codebooks by looking at every entry in every round, with Python integers."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for v in cut:
                members[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(members, books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [bytes(k for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


def rows_of(df):
    return sorted(((r[0] is None, r[0] or 0), bytes(r["code"]), r["error"], r["label_error"]) for r in df.collect())


@pytest.mark.parametrize("seed,n,dims,parts,entries,rounds,near,spread", [
    (1, 400, 16, 4, 16, 6, 4, 3.0), (2, 300, 8, 2, 5, 8, 1, 0.002), (3, 250, 6, 3, 30, 4, 20, 1.0), (4, 9, 4, 2, 16, 3, 4, 1.0),
    (5, 60, 4, 4, 1, 2, 4, 1.0), (6, 500, 4, 1, 16, 12, 2, 0.001)])
def test_codes_are_brute_force(spark, seed, n, dims, parts, entries, rounds, near, spread):
    rng = np.random.default_rng(seed)
    data = (rng.normal(0, spread, (n, dims)) + rng.integers(0, 4, (n, 1)) * spread).astype(np.float32)
    data[n // 2:n // 2 + n // 8] = data[0]                                     # copies
    labels = [None if k % 7 == 0 else k % 3 for k in range(n)]
    df = spark.createDataFrame([(k, data[k].tolist(), labels[k]) for k in range(n)], "vec_id long, embedding array<float>, label int")
    q = np.floor(data.astype(np.float64) * 4096).astype(int).tolist()
    codes, errors, books = brute(q, parts, entries, rounds)
    got, got_books = vc.vector_codes(df.repartition(3), parts=parts, entries=entries, rounds=rounds, near=near)
    assert got_books.tolist() == [[list(e) for e in b] for b in books]
    by_label = {x: sum(e for e, y in zip(errors, labels) if y == x) for x in set(labels)}
    assert rows_of(got) == sorted(((False, k), codes[k], errors[k], by_label[labels[k]]) for k in range(n))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, -4.0], 1), (5, [1.0, 2.0, 3.0, -4.0], 1), (None, [0.5, 0.5, 0.25, 9.0], None), (2, None, 1),
            (1, [1.0, None, 2.0, 3.0], 1), (0, [nan, 1.0, 1.0, 1.0], 1), (3, [inf, 1.0, 1.0, 1.0], 1), (4, [-inf, 1.0, 1.0, 1.0], 1),
            (7, [-0.0001, 0.0, -1.0, 30000.0], None), (9, [1.0, 2.0], 3), (10, [], 3)]
    df = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows],
                               "vec_id long, embedding array<double>, label int, code string, total int, q binary")
    kept = [rows[0], rows[1], rows[8], rows[2]]                                # by id, null last
    q = [[int(np.floor(x * 4096)) for x in r[1]] for r in kept]
    codes, errors, books = brute(q, 2, 3, 2)
    got, got_books = vc.vector_codes(df, parts=2, entries=3, rounds=2)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert got_books.tolist() == [[list(e) for e in b] for b in books]
    by_label = {x: sum(e for e, r in zip(errors, kept) if r[2] == x) for x in (1, None)}
    assert rows_of(got) == sorted((((r[0] is None, r[0] or 0), c, e, by_label[r[2]]) for r, c, e in zip(kept, codes, errors)))
    for none in (df.where("false"), df.where("vec_id = 10"), df.where("vec_id = 2")):
        got, got_books = vc.vector_codes(none, parts=2, entries=3, rounds=2)
        assert got.collect() == [] and got_books.size == 0


def test_beyond_the_range_raises(spark):
    df = spark.createDataFrame([(1, [1e6, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="after scaling"):
        vc.vector_codes(df, parts=1, entries=2, rounds=1)


def test_bounds_spare_entries_and_shrink():
    """On settled codebooks most parts look at no entry, and those that look see few."""
    rng = np.random.default_rng(0)
    points = (rng.normal(0, 40, (3000, 4)) + 400 * rng.integers(0, 8, (3000, 1))).astype(np.int64)
    book = points[:16]
    state = vc.Bounds(points, book, 6)
    state.fresh()
    near, low = state.near, state.low
    moved = book + rng.integers(-2, 3, book.shape)
    state = vc.Bounds(points, moved, 3)                                        # a shorter list than the one before
    state.moved(near, low, vc._up(((moved - book) ** 2).sum(axis=1)))
    exact = ((points[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (state.near[:, 0] == exact.argmin(axis=1)).all()
    assert (state.needed == 0).mean() > 0.3 and (state.needed <= 3).mean() > 0.9
    d = np.sqrt(np.take_along_axis(exact, state.near.astype(int), axis=1))
    assert (state.low[:, 1:4] <= d[:, 1:]).all() and (state.low[:, 0] >= d[:, 0]).all()
    assert (np.diff(state.low[:, 1:], axis=1) >= 0).all()
    rest = np.sort(exact, axis=1)
    beyond = np.array([np.sqrt(np.delete(e, n).min()) for e, n in zip(exact, state.near.astype(int))])
    assert (state.low[:, 4] <= beyond).all() and len(rest) == 3000


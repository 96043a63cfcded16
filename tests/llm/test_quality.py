import numpy as np
import pytest
from civicflow.llm.common import fold
from civicflow.llm.quality import Features, Shapes, dual_descent, fit_quality, logistic_curve, quality_score, shape
from pyspark.sql import functions as F

LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = fit_quality(docs, labels, ~held)
    rows = docs.where(held).join(labels, "doc_id").select("quality", quality_score(model).alias("s")).collect()
    assert np.mean([r["s"] >= 0.7 for r in rows if r["quality"] == 1]) >= 0.99
    assert np.mean([r["s"] >= 0.7 for r in rows if r["quality"] == 0]) <= 0.05


def test_shapes():
    assert [shape(w) for w in ("Tion,", "the$$$", "ABC!!", "a1b", "|")] == ["Aa,", "a$", "A!", "a0a", "|"]
    s = Shapes()
    assert s("the cat sat").tolist() != s("the the the").tolist()
    assert s("the cat sat").tolist() == s("one dog ran").tolist()
    assert s("").tolist() == s(None).tolist() == []


def test_pieces_count_at_every_length():
    s = Shapes()
    part = set(s("a-").tolist())
    for pairs in (2, 31, 32, 33, 60):                                   # shapes of 4, 62, 64, 66 and 120 characters
        assert part <= set(s("ab-" * pairs).tolist()), pairs


def test_words_decide_where_shapes_cannot(spark):
    good, bad = "solid tidy clear sound".split(), "shoddy sloppy vague wrong".split()
    texts = [(" ".join((good if k % 2 else bad)[(k // 2 + j) % 4] for j in range(3 + k % 5)), k % 2) for k in range(240)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(texts)], "doc_id long, quality int")
    hits = {}
    for kind in (Shapes, Features):
        model = fit_quality(docs, labels, F.col("doc_id") % 240 >= 60, features=kind)
        hits[kind] = np.mean([(model.score(t) >= 0.5) == (q == 1) for t, q in texts[:60]])
    assert hits[Features] == 1.0 and hits[Shapes] < 0.7
    assert Features()("").tolist() == Features()(None).tolist() == []


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(200)]
    y = np.array([1.0 if (r < 10).sum() > (r > 20).sum() else -1.0 for r in rows])
    ratio = np.ones(30)
    w, b = dual_descent(rows, ratio, y, epochs=400)

    def primal(w, b):
        m = np.array([w[r].sum() + b for r in rows])
        return 0.5 * (w @ w + b * b) + (np.maximum(1 - y * m, 0) ** 2).sum()

    best = primal(w, b)
    for _ in range(200):
        assert primal(w + rng.normal(0, 0.02, 30), b + rng.normal(0, 0.02)) >= best - 1e-3


def test_logistic_curve_rises_with_the_margin():
    slope, shift = logistic_curve(np.array([-2.0, -1, 1, 2, -1.5, 1.5]), np.array([-1.0, -1, 1, 1, -1, 1]))
    assert slope > 0 and 1 / (1 + np.exp(-(2 * slope + shift))) > 0.6


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    for docs, known in ((odd_docs, labels), (odd_docs, labels.where("quality = 1")), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = fit_quality(docs, known, F.lit(True))
        scores = [r["s"] for r in docs.select(quality_score(model).alias("s")).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert fit_quality(no_docs, labels, F.lit(True)).score("x") == pytest.approx(0.5)


def test_a_text_without_spaces_counts_whole():
    text = "これは日本語の文章です、空白はありません。" * 5
    noise = "$$$###%%%" * 100
    assert shape(text[:70]) != shape(text[:64] + noise)
    s = Shapes()
    clean, tail = s(text), s(text + noise)
    assert set(clean.tolist()) != set(tail.tolist()) and not s.known            # long words are not kept
    known = set(s("the$$$").tolist())
    assert known <= set(s(text + "the$$$" * 100).tolist()) and not known & set(clean.tolist())
    assert shape("Ab1" * 1_000_000) == "Aa0" * 1_000_000


def test_noise_after_the_first_characters_lowers_the_score(spark):
    prose = "これは日本語の文章です、空白はありません。"
    texts = [(prose * (10 + k % 7) + "終" * k, 1) for k in range(60)] + [(prose * (10 + k % 7) + "$$$###%%%" * (20 + k), 0) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(texts)], "doc_id long, quality int")
    model = fit_quality(docs, labels, F.col("doc_id") % 60 >= 20)
    held = [(model.score(t), q) for k, (t, q) in enumerate(texts) if k % 60 < 20]
    assert min(s for s, q in held if q == 1) > max(s for s, q in held if q == 0)

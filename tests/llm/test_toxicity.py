import numpy as np
from civicflow.llm.common import fold
from civicflow.llm.toxicity import IDENTITY, fit_toxicity, fit_weights, swapped, toxicity_score, words_of
from pyspark.sql import functions as F

LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    model = fit_toxicity(docs, labels, ~held)
    rows = docs.where(held).join(labels, "doc_id").select("toxic", toxicity_score(model).alias("s")).collect()
    hit = [r["s"] >= 0.5 for r in rows if r["toxic"] == 1]
    clean = [r["s"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert np.mean(hit) >= 0.85 and np.mean(clean) <= 0.01


def test_swap():
    assert swapped({"a", "muslim"}) == {"a", "jewish"}
    assert swapped({"women"}) == {"men"} and swapped({"a", "b"}) is None
    terms = [t for row in IDENTITY for t in row]
    assert len(terms) == len(set(terms))


def neutral_and_hostile(spark):
    """Toxic rows name one group more often than clean ones do, as in biased labels."""
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        group = "muslim" if (k % 10 < 8) == bool(toxic) else "christian"
        rows.append((k, f"the {group} neighbour {'is vile scum' if toxic and k % 4 == 1 else 'came to town'} today x{k % 7}"))
        labels.append((k, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_penalty_takes_the_weight_off_group_names(spark):
    docs, labels = neutral_and_hostile(spark)
    gaps = {}
    for penalty in (0.0, 20.0):
        model = fit_toxicity(docs, labels, F.lit(True), penalty=penalty)
        gaps[penalty] = abs(model.score("the muslim neighbour came to town") - model.score("the jewish neighbour came to town"))
        assert model.score("the christian neighbour is vile scum") > 0.5
    assert gaps[20.0] < 0.02 < gaps[0.0]


def test_twins_enter_the_loss():
    rows, y = [[0, 1], [1], [0, 1], [1]], np.array([1.0, 0, 1, 0])
    free, _ = fit_weights(rows, y, [], 3, penalty=5.0, ridge=1e-4)
    tied, _ = fit_weights(rows, y, [([0], [2])], 3, penalty=5.0, ridge=1e-4)
    assert abs(tied[0] - tied[2]) < 0.3 * abs(free[0] - free[2])


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    for docs, known in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = fit_toxicity(docs, known, F.lit(True))
        scores = [r["s"] for r in docs.select(toxicity_score(model).alias("s")).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert words_of(None) == set()

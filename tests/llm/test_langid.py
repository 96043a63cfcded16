import zlib

import numpy as np
from civicflow.llm.common import fold
from civicflow.llm.langid import WINDOW, fit_language_model, language_of, language_sample, predict, train
from pyspark.sql import functions as F

MEDIUM = "/root/testdata/sf0.01"


def fitted(docs):
    usable = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    return fit_language_model(docs, usable)


def test_fold_is_crc32_of_the_id_as_text(spark):
    for r in spark.range(0, 3000, 37).select("id", fold("id", 4).alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["id"]).encode()) % 4


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = fitted(docs)
    again = fitted(docs.repartition(7))
    assert all((model.filters[w] == again.filters[w]).all() for w in model.filters)
    found = docs.where(fold("doc_id", 4) == 2).select("lang", language_of(model).alias("f")).collect()
    assert np.mean([r["lang"] == r["f"]["lang"] for r in found]) >= 0.97
    assert all(0 <= r["f"]["score"] <= 1 for r in found)


def test_tables_equal_direct_convolution():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(97, 123, (40, WINDOW)).astype(np.uint8), rng.integers(0, 2, 40)
    model = train(windows, labels, ["x", "y"], epochs=1)
    text = windows[:3].tobytes()[:600]                        # two whole windows and a part
    want, weight = np.zeros(2), 0
    for k in range(0, len(text), WINDOW):
        part = np.frombuffer(text[k:k + WINDOW].ljust(WINDOW, b"\0"), np.uint8)
        pooled = []
        for w, t in sorted(model.filters.items()):
            last = np.concatenate([part, np.zeros(0, np.uint8)])
            pooled.append(np.max([sum(t[j][last[p + j]] for j in range(w)) for p in range(WINDOW - w + 1)], axis=0))
        logits = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.dense + model.dense_bias
        n = min(WINDOW, len(text) - k)
        want, weight = want + logits * n, weight + n
    want = np.exp(want / weight - (want / weight).max())
    at, prob = predict(model, model.pair_tables(), [text])
    assert at[0] == want.argmax() and abs(prob[0] - (want / want.sum()).max()) < 1e-4


def test_odd_rows_and_columns(spark, odd_docs):
    docs = odd_docs.unionByName(spark.createDataFrame(
        [(100 + k, "the cat and the dog" if k % 2 else "le chat et le chien", "en" if k % 2 else "fr", None, 1, None, None, None, None)
         for k in range(40)], odd_docs.schema))
    found = {(r["doc_id"], r["text"]): r["f"] for r in docs.select("*", language_of(fitted(docs)).alias("f")).collect()}
    for (_, text), f in found.items():
        if not any(c.isalpha() for c in text or ""):
            assert f["lang"] == "und" and f["score"] == 0
        else:
            assert f["lang"] in ("en", "fr")


def test_no_labels_and_empty_table(spark, no_docs):
    assert fitted(no_docs) is None
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert docs.select(language_of(fitted(docs)).alias("f")).first()["f"]["lang"] == "und"
    assert no_docs.select(language_of(None).alias("f")).collect() == []


def test_copies_do_not_crowd_out_a_language(spark):
    copies = spark.range(6000).selectExpr("id AS doc_id", "'eki boku copied text of the second kind' AS text", "'bb' AS lang")
    few = spark.range(20).selectExpr("id + 6000 AS doc_id", "concat('eki boku ', id, ' zuki naku taru') AS text", "'bb' AS lang")
    many = spark.range(500).selectExpr("id + 7000 AS doc_id", "concat('the cat and ', id, ' more dogs went home') AS text", "'aa' AS lang")
    docs = copies.union(few).union(many)
    sample = language_sample(docs, F.lit(True), per_lang=50).groupBy("lang").count()
    assert {r["lang"]: r["count"] for r in sample.collect()} == {"aa": 50, "bb": 21}
    model = fit_language_model(docs, F.lit(True), per_lang=50)
    found = docs.select("lang", language_of(model).alias("f")).where("lang <> f.lang").count()
    assert model.langs == ["aa", "bb"] and found < 20


def test_every_language_is_learned(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('word', id, ' text') AS text", "concat('l', id % 300) AS lang")
    sample = language_sample(docs, F.lit(True), per_lang=1500, most=450).groupBy("lang").count().collect()
    assert len(sample) == 300 and {r["count"] for r in sample} == {1}
    assert len(fit_language_model(docs, F.lit(True)).langs) == 300

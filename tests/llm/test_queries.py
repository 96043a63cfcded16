"""The registered queries: against their SQL where there is one, and the pipeline stage by stage."""

import __spark_entry__ as E
import corpus_pipeline
import oracle_check
import pytest
from civicflow.llm import queries
from civicflow.llm.simhash import fingerprint
from oracle_check import digest, duck, rows_of, spark_types
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
oracle_check.EXACT = True


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    df = E.queries()[name](spark, SMALL)
    cols, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck(SMALL).execute(queries.ORACLE[name])
    want_cols, want = rows_of([d[0] for d in found.description], found.fetchall())
    assert (cols, digest(rows)) == (want_cols, digest(want))
    assert spark_types(df) == {d[0]: str(d[1]) for d in found.description}


def test_all_are_registered():
    names = [n for n in E.queries() if n in queries.QUERIES]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{k}" for k in range(1, 14)] + ["pipeline"])


CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_packing": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
    "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_align_tokenizers": {"groups_sha256": "string"} | {c: "bigint" for c in (
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")},
    "op12_quality_rules": {"base_failed": "boolean", "kept": "boolean"} | {c: "bigint" for c in (
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns_and_every_document(spark, name):
    df = E.queries()[name](spark, SMALL)
    assert CONTRACT[name].items() <= dict(df.dtypes).items()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
    if name != "op3_packing":
        assert df.count() == docs.count()


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    table = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string, fp string"
    clean = spark.createDataFrame([(200 + k, f"{'the cat and' if k % 2 else 'le chat et'} number{k} went on its way", "en" if k % 2 else "fr",
                                    f"s{k % 3}", 20, None, None, None, None) for k in range(30)], table)
    docs = odd_docs.unionByName(clean)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert stage(spark, no_docs, SMALL).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "language_id":
            kept = [r["text"] for r in docs.collect()]
            assert all(t and any(c.isalpha() for c in t) for t in kept) and docs.where("doc_id >= 200").count() == 30
        if name == "simhash_near_dedup":
            groups = queries.simhash_groups(docs).select("component_id").distinct().count()
            assert docs.select("doc_id").distinct().count() == groups
    assert out.agg(F.sum("length")).first()[0] > 0


INNER = ["found", "doc", "removed", "row", "_found", "_doc", "_removed", "_row", "_starts", "_lens", "_cut", "_run_id", "_run_th", "_id", "_th",
         "_text", "_hit", "h", "size", "nth", "sid", "copies", "delta", "rate", "tau", "lam", "target", "_source", "_sid", "_h", "_nth", "_numbered",
         "fp", "key", "node", "label", "first", "group", "h2", "texts", "cut", "rank", "source_size", "mean"]


def test_columns_called_like_inner_ones_keep_their_values(spark):
    """Every stage passes columns of any name on unchanged, and decides as it does without them."""
    line = " ".join(f"p{k}" for k in range(60))
    texts = [f"the cat and the dog number{k} went on their way home" for k in range(25)] + [f"{line}\nthe end of it", f"the start of it\n{line}"]
    plain = spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    extra = plain.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in INNER])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(tuple(r) for r in stage(spark, plain, SMALL).collect())
        out = stage(spark, extra, SMALL)
        assert out.columns == extra.columns
        rows = out.collect()
        assert sorted(tuple(r)[:5] for r in rows) == want and want
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in INNER)


def test_line_dedup_stage_updates_sizes(spark):
    line = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{line}\nx", 9), (2, f"y\n{line}", 9)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert got[1]["n_chars"] == 9 and got[2]["text"] == "y" and got[2]["n_chars"] == 1


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    """Repeated rows, copies without ids, an id with two texts, and a null-id row near a kept one."""
    words = [f"w{k}" for k in range(1000)]
    text, near = " ".join(words), " ".join([*words, "more"])
    fps = [fingerprint(t.encode(), 3) & (1 << 64) - 1 for t in (text, near)]
    assert 1 <= (fps[0] ^ fps[1]).bit_count() <= 2
    apart, lone = "something else altogether here", "copies that have no id at all"
    rows = [(5, text, "a"), (5, text, "a"), (5, text, "b"), (7, text, "c"), (None, text, "d"), (None, near, "e"), (9, near, "f"),
            (20, apart, "g"), (3, apart, "h"), (3, lone + " and more words", "i"), *[(None, lone, "j")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4, "source")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_near_dedup(spark, docs, SMALL).collect()), key=repr)
    assert got == sorted([(5, text), (3, apart), (3, lone + " and more words"), (None, lone)], key=repr)


def test_near_dedup_stage_links_through_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(1000)]
    text, near = " ".join(words), " ".join([*words, "more"])
    docs = spark.createDataFrame([(None, text), (None, text), (None, near)], "doc_id long, text string")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, SMALL).count() == 1


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0

import hashlib
import re

from civicflow.llm.exact_dedup import normalised, progressive_exact_dedup
from pyspark.sql import functions as F


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    out = []
    for norm, rs in groups.items():
        rs = sorted(rs, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out += [(r["doc_id"], rs[0]["doc_id"], len(rs), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, r in enumerate(rs)]
    return sorted(out, key=repr)


def result(df):
    found = progressive_exact_dedup(df, slots=64, carry={"text_sha256": F.sha2(normalised(), 256)})
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_brute_force_on_odd_rows(odd_docs):
    got = result(odd_docs)
    assert [(a, b, c, d, e) for a, b, c, d, e in got] == brute(odd_docs.collect())


def test_same_length_and_prefix_but_other_text(spark):
    head = "x" * 100
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + " a"), (4, "y" * 101)], "doc_id long, text string")
    assert result(df) == brute(df.collect())


def test_one_row_of_a_group_stays(spark):
    rows = [(1, "a b c"), (1, "a  b   c"), (2, "abc"), (None, "x y"), (None, "x y"), (None, "xy"), (5, "q"), (5, "q"), (5, "q"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(df.collect())
    kept = progressive_exact_dedup(df).where("kept").select("keep_id", "group_size").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, 3), (None, 3), (5, 4)], key=repr)


def test_empty_table(no_docs):
    assert result(no_docs) == []


def test_no_python_in_the_plan(odd_docs, capsys):
    progressive_exact_dedup(odd_docs).explain("formatted")
    assert "Python" not in capsys.readouterr().out

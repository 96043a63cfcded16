import math
import re

import numpy as np
import pytest
from civicflow.llm.quality_rules import RULES, apply_quality_rules, fit_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t", "a", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 300, "a a a a a a a", "one\none\n\none\ntwo\r\ntwo",
       "#*$%&|<> ok", "日本語 のテキスト。\nです。", "end.\x85\nnext! \nlast?", "1 2 3 4 5 6 1 2 3 4 5 6 7 1 2 3 4 5", "\n".join(["same line here now."] * 40),
       " ".join(f"word{k % 61}" for k in range(20_000)), "a" * 50_000, "The quick brown fox jumps over the lazy dog near the river bank. " * 1 + "It was a sunny day."]


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {k + i for k, w in enumerate(windows) if seen[w] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines)}


def vote(name, c):
    good, bad = ("".join(x).replace("AND", "and").replace("OR", "or").replace(" = ", " == ") for x in RULES[name])
    return 0 if not c["n_words"] else 1 if eval(good, {}, c) else -1 if eval(bad, {}, c) else 0


def em(patterns, rounds=20):
    """(share of good, accuracies) from (votes, number) pairs, in plain Python."""
    g, a = 0.5, [0.8] * len(patterns[0][0])

    def post(v):
        odds = math.log(g / (1 - g)) + sum(x * math.log(p / (1 - p)) for x, p in zip(v, a))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = [post(v) for v, _ in patterns]
        total = sum(n for _, n in patterns)
        new = [(8 + sum(n * (q if v[k] == 1 else 1 - q) for (v, n), q in zip(patterns, p) if v[k]))
               / (10 + sum(n for v, n in patterns if v[k])) for k in range(len(a))]
        g = min(0.95, max(0.05, sum(n * q for (_, n), q in zip(patterns, p)) / total))
        a = [min(0.98, max(0.55, x)) for x in new]
    return g, a, post


def test_counts_votes_and_verdicts_are_brute_force(spark):
    rows = list(enumerate(ODD)) + [(4, "a b c d e"), (None, "no id but some words"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, n_words int, c string, posterior double")
    judged, model = apply_quality_rules(docs)
    assert judged.columns[:6] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] or "doc_id" in judged.columns
    got = judged.collect()
    want = [(i, counts(t)) for i, t in rows]
    names = list(want[0][1])
    assert sorted([(r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in names)) for r in got]) == sorted(
        [(i is None, i or 0, *c.values()) for i, c in want])
    votes = [tuple(r[f"vote_{n}"] for n in RULES) for r in got]
    g, a, post = em([(v, 1) for v in votes])
    assert model.good == pytest.approx(g) and list(model.accuracy) == pytest.approx(a)
    for r, v in zip(got, votes):
        assert r["posterior"] == pytest.approx(post(v))
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and post(v) >= 0.5)
        for n in ("length", "word_size", "symbols", "repeats"):
            assert r[f"vote_{n}"] == vote(n, r.asDict())


def test_accuracies_are_found_without_labels(spark):
    rng = np.random.default_rng(3)
    true = [0.95, 0.9, 0.7, 0.6]
    good = rng.random(20_000) < 0.7
    cast = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < p, 1, -1) * np.where(good, 1, -1)) for p in true], 1)
    kinds, n = np.unique(cast, axis=0, return_counts=True)
    names = [f"v{k}" for k in range(4)]
    model = fit_rules(spark.createDataFrame([(*map(int, k), int(c)) for k, c in zip(kinds, n)], ", ".join(f"{c} int" for c in [*names, "n"])),
                      names, rounds=60)
    assert model.good == pytest.approx(0.7, abs=0.03)
    assert list(model.accuracy) == pytest.approx(true, abs=0.04)


def test_one_bad_vote_is_outvoted_and_empty_tables(spark, odd_docs, no_docs):
    clean = [f"The number {k} bus runs past the old town hall every morning and stops near the market. "
             f"It takes about {k} minutes to reach the harbour, where ships from many countries arrive at noon." for k in range(40)]
    noisy = [f"$$$ %% || {k} ## && " * 30 for k in range(10)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*clean, clean[0].replace("morning", "#morning"), *noisy])], "doc_id long, text string")
    judged, model = apply_quality_rules(docs)
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert kept == set(range(41))                     # one rule's vote against document 40 does not drop it
    assert judged.where("doc_id = 40").first()["vote_symbols"] != 1
    assert apply_quality_rules(no_docs)[0].collect() == []
    assert apply_quality_rules(odd_docs)[0].count() == odd_docs.count()


def test_no_python_in_the_plan(spark, odd_docs):
    judged, _ = apply_quality_rules(odd_docs)
    plan = judged._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

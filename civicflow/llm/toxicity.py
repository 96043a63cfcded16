"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are a text's words and the beginnings of its words, picked by their
log-odds between toxic and other labelled texts. In training, identity terms in
the labelled texts are swapped for other terms of the same kind, and the change
of the score between a text and its swapped twin is penalised, so that naming a
group does not by itself make a text toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)

#: Terms that are swapped within their row.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf"), ("old", "young"), ("elderly", "youthful"),
)


@dataclass
class ToxicityModel:
    features: dict[str, int]            # "word" or "stem-" -> place in weights
    weights: np.ndarray
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            names = [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]
            got = tuple(self.features[x] for x in names if x in self.features)
            if len(self.known) < 300_000:
                self.known[word] = got
        return got

    def places(self, words: set[str]) -> list[int]:
        return sorted({k for w in words for k in self.of_word(w)})

    def score(self, text: str | None) -> float:
        z = float(self.weights[self.places(words_of(text))].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def swapped(words: set[str], groups=IDENTITY) -> set[str] | None:
    """``words`` with every identity term replaced by the next of its row; None without one."""
    nxt = {t: row[(k + 1) % len(row)] for row in groups for k, t in enumerate(row)}
    hit = words & nxt.keys()
    return (words - hit) | {nxt[t] for t in hit} if hit else None


def choose_features(sample: DataFrame, most: int, least_texts: int = 3) -> list[str]:
    """The ``most`` words and stems that speak most surely for class 1: their
    log-odds over its standard error, counted over all of the sample."""
    words = sample.select("label", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))).alias("w"))
    one, zero = F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") != 1).cast("long"))
    counts = words.groupBy("w").agg(one.alias("a"), zero.alias("b"))
    stems = F.explode(F.concat(F.array("w"), F.filter(F.array(*[
        F.when(F.char_length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("-"))) for n in STEMS]),
        lambda x: x.isNotNull())))
    totals = sample.agg(one.alias("a"), zero.alias("b")).first()
    n1, n0 = float(totals["a"] or 0), float(totals["b"] or 0)
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = (counts.select(stems.alias("f"), "a", "b").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
           .where(F.col("a") + F.col("b") >= least_texts).orderBy(z.desc(), "f").limit(most))
    return [r["f"] for r in top.select("f").collect()]


def fit_weights(rows: list[list[int]], y: np.ndarray, twins: list[tuple[list[int], list[int]]], n_features: int, *,
                penalty: float, ridge: float, steps: int = 1000, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Adam on mean log-loss + ridge |w|^2 + penalty * mean (score change of a twin)^2."""
    def flat(lists):
        sizes = np.array([len(x) for x in lists], np.int64)
        cols = np.array([c for x in lists for c in x], np.int64)
        return np.repeat(np.arange(len(lists)), sizes), cols

    who, cols = flat(rows)
    t_who, t_cols = flat([a + b for a, b in twins])
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in twins]) if twins else np.zeros(0)
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.bincount(who, w[cols], len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = np.bincount(cols, err[who], n_features) + 2 * ridge * w
        if len(twins):
            change = np.bincount(t_who, sign * w[t_cols], len(twins))
            g += 2 * penalty / len(twins) * np.bincount(t_cols, sign * change[t_who], n_features)
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        mb, vb = mb + 0.1 * (err.sum() - mb), vb + 0.001 * (err.sum() ** 2 - vb)
        fix1, fix2 = 1 - 0.9 ** k, 1 - 0.999 ** k
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-9)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-9)
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, label_col: str = "toxic",
                 text_col: str = "text", id_col: str = "doc_id", most_rows: int = 30_000, most_features: int = 4096,
                 penalty: float = 1.0, ridge: float = 2e-6, groups=IDENTITY) -> ToxicityModel:
    """Fit on about ``most_rows`` labelled ``usable`` rows and ``most_features`` features, at any
    corpus size. Without labelled rows of both classes every text scores the
    share of label 1 (0 without any)."""
    sample = labelled_sample(docs, labels, usable, label_col, most=most_rows, id_col=id_col, text_col=text_col)
    terms = [t for row in groups for t in row]
    names = list(dict.fromkeys([*choose_features(sample, most_features), *terms]))
    model = ToxicityModel({f: k for k, f in enumerate(names)}, np.zeros(len(names)), -60.0)

    @F.pandas_udf("own array<int>, twin array<int>")
    def features(texts: pd.Series) -> pd.DataFrame:
        own = [words_of(t) for t in texts]
        twins = [swapped(x, groups) for x in own]
        return pd.DataFrame({"own": [model.places(x) for x in own],
                             "twin": [None if x is None else model.places(x) for x in twins]})

    rows = sample.select("label", features("text").alias("f")).select("label", "f.*").orderBy("label", "own").collect()
    y = np.array([float(r["label"] == 1) for r in rows])
    if len(rows):
        twins = [(list(r["own"]), list(r["twin"])) for r in rows if r["twin"] is not None]
        model.weights, model.bias = fit_weights([list(r["own"]) for r in rows], y, twins, len(names),
                                                penalty=penalty, ridge=ridge)
    return ToxicityModel(model.features, model.weights, model.bias)


def toxicity_score(model: ToxicityModel, text_col: str = "text") -> Column:
    """Score of a whole text, 0 to 1. Null and empty texts have no feature and score the
    bias alone; repeated rows score alike; no other column is looked at."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.col(text_col))

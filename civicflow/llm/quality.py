"""Quality: naive Bayes support vectors over n-grams of words and word shapes.

A word's shape says of which kinds of characters it consists, in order, and
whether it repeats the word before. The indicators of a text's n-grams, of shapes and
of the words themselves, are scaled by the log ratio of their counts in the two classes, and a linear model
with hinge loss is fitted to them by dual coordinate descent. A logistic curve
over the margin turns it into a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

BUCKETS = 1 << 18
RUN = re.compile(r"(.)\1+", re.S)
PIECE = re.compile(r"[Aa0]+[^Aa0]{0,3}|[^Aa0]{1,3}", re.S)
AGAIN = zlib.crc32(b"=")
KEPT = 64                               # characters of the longest word whose ids are kept; longer ones are made anew


class Kinds(dict):
    """Translation table from a character to its kind, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS = Kinds()


def shape(word: str) -> str:
    """``Tion,`` -> ``Aa,``; ``the$$$`` -> ``a$``: runs of like characters become one. The whole word, however long."""
    return RUN.sub(r"\1", word.translate(KINDS))


def shape_ids(word: str) -> list[int]:
    """The id of a word's shape, then those of its pieces where it has more than one: a long
    shape (a text without white space) hardly occurs twice, its pieces do."""
    whole = shape(word)
    pieces = PIECE.findall(whole)
    return [zlib.crc32(s.encode("utf-8", "replace")) for s in (whole, *(pieces if len(pieces) > 1 else ()))]


def buckets(ids: list[int], longest: int) -> np.ndarray:
    """Distinct buckets of the 1- to ``longest``-grams (3 at most) of a sequence of ids."""
    x = np.array(ids, np.uint64)
    grams = [x * np.uint64(0x9E3779B97F4A7C15)]
    two = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams.append(two)
    if longest > 2 and len(x) > 2:
        grams.append(two[:-1] * np.uint64(0x165667B19E3779F9) + x[2:])
    every = np.concatenate(grams)
    every ^= every >> np.uint64(29)
    return np.unique((every * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)).astype(np.int64)


class Shapes:
    """Buckets of a text's shape 1- to 3-grams; ids of frequent words are kept."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def ids(self, word: str) -> tuple[int, list[int]]:
        """A word's own id (without case) and those of its shape."""
        got = self.known.get(word)
        if got is None:
            got = zlib.crc32(word.lower().encode("utf-8", "replace")), shape_ids(word)
            if len(word) <= KEPT and len(self.known) < self.most:
                self.known[word] = got
        return got

    def sequences(self, text: str | None) -> tuple[list[int], list[int]]:
        words, shapes, before = [], [], None
        for w in (text or "").split():
            own, kinds = self.ids(w)
            words.append(own)
            if w == before:
                shapes.append(AGAIN)
            else:
                shapes += kinds
            before = w
        return words, shapes

    def __call__(self, text: str | None) -> np.ndarray:
        return buckets(self.sequences(text)[1], 3)


class Features(Shapes):
    """Buckets of shape 1- to 3-grams and, after those, of word 1- and 2-grams."""

    def __call__(self, text: str | None) -> np.ndarray:
        words, shapes = self.sequences(text)
        return np.concatenate([buckets(shapes, 3), BUCKETS + buckets(words, 2)])


@dataclass
class QualityModel:
    weights: np.ndarray                 # ratio times hinge weight, by bucket
    bias: float
    slope: float                        # of the logistic curve over the margin
    shift: float
    features: Shapes = field(default_factory=Features)

    def margin(self, text: str | None) -> float:
        return float(self.weights[self.features(text)].sum()) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -60, 60))))


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, *, c: float = 1.0, epochs: int = 12,
                 seed: int = 5) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge fit by dual coordinate descent (Hsieh et al. 2008).
    Rows are scaled to unit length; the bias is one more feature, always present."""
    w, b, rng = np.zeros(len(ratio)), 0.0, np.random.default_rng(seed)
    values = [ratio[r] for r in rows]
    norm = [float(v @ v) + 1.0 for v in values]
    alpha, diag = np.zeros(len(rows)), 1 / (2 * c)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            v = values[i]
            g = y[i] * (w[rows[i]] @ v + b) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / (norm[i] + diag), 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * v
                b += step
                moved, alpha[i] = max(moved, abs(step)), new
        if moved < 1e-4:
            break
    return w * ratio, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of sigmoid(slope * margin + shift) by Newton steps, targets off 0 and 1 (Platt)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(p @ x, -60, 60)))
        hess = (x * (s * (1 - s))) @ x.T + 1e-6 * np.eye(2)
        p = p - np.linalg.solve(hess, x @ (s - t))
    return float(p[0]), float(p[1])


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, *, label_col: str = "quality",
                text_col: str = "text", id_col: str = "doc_id", most_rows: int = 20_000,
                features: type[Shapes] = Features) -> QualityModel:
    """Fit on about ``most_rows`` labelled ``usable`` rows at any corpus size. The last fifth
    of them (by a hash of their features) is left out of the hinge fit and fits
    the logistic curve. Without labelled rows every text scores 0.5; with one
    class only, near that class. ``features=Shapes`` leaves the words out."""
    sample = labelled_sample(docs, labels, usable, label_col, most=most_rows, id_col=id_col, text_col=text_col)

    @F.pandas_udf("binary")             # packed: a list of Python numbers would be ten times as large on the driver
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = features()
        for texts in batches:
            yield pd.Series([found(t).astype("<i4").tobytes() for t in texts])

    got = sample.select("label", grams("text").alias("f")).orderBy(F.xxhash64("f"), "label").collect()
    if not got:
        return QualityModel(np.zeros(2 * BUCKETS), 0.0, 1.0, 0.0, features())
    rows = [np.frombuffer(r["f"], "<i4") for r in got]
    y = np.array([1.0 if r["label"] == 1 else -1.0 for r in got])
    last = len(rows) * 4 // 5 if len(rows) >= 50 else len(rows)
    fit, calib = range(last), range(last, len(rows)) if last < len(rows) else range(len(rows))
    counts = {s: np.ones(2 * BUCKETS) for s in (1.0, -1.0)}
    for i in fit:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    weights, bias = dual_descent([rows[i] for i in fit], ratio, y[:last])
    margin = np.array([weights[rows[i]].sum() + bias for i in calib])
    slope, shift = logistic_curve(margin, y[list(calib)])
    return QualityModel(weights.astype(np.float32), bias, slope, shift, features())


def quality_score(model: QualityModel, text_col: str = "text") -> Column:
    """Score of a whole text, 0 to 1. Null and empty texts have no n-gram and score the
    bias alone; repeated rows score alike; no other column is looked at."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.col(text_col))

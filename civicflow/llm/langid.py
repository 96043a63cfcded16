"""Language identification by a byte convolutional network.

A window of 256 bytes runs through byte filters of several widths, each filter
keeps its largest response (max pooling), and a softmax layer turns those into
language logits. The network is trained in numpy on a bounded sample of labelled
windows; a text is cut into windows from end to end, and its logits are the mean
over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 256
LETTER = r"\p{L}"
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """``filters[w]``: (w, 256, f) response of filter f to a byte at each of its w places."""
    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pair_tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Per width: (place, responses to the two bytes there), so that a filter
        of width w costs about w / 2 look-ups a byte."""
        out = []
        for w, t in sorted(self.filters.items()):
            pairs = [(j, (t[j][:, None, :] + (t[j + 1][None, :, :] if j + 1 < w else 0)).reshape(-1, t.shape[2])
                      if j + 1 < w else np.repeat(t[j], 256, axis=0)) for j in range(0, w, 2)]
            out.append((w, pairs))
        return out


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], *, widths=(2, 3, 4), n_filters: int = 16,
          epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the mean cross-entropy. ``windows``: (n, 256) bytes, ``labels``: (n,) indices."""
    rng = np.random.default_rng(seed)
    p = {w: rng.normal(0, 0.1, (w, 256, n_filters)).astype(np.float32) for w in widths}
    p |= {"b": np.zeros(len(widths) * n_filters, np.float32), "c": np.zeros(len(langs), np.float32),
          "d": rng.normal(0, 0.1, (len(widths) * n_filters, len(langs))).astype(np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    cols = np.arange(n_filters)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x, y = np.ascontiguousarray(windows[pick].T), labels[pick]            # (256, batch)
            best, pooled = {}, []
            for w in widths:
                n = len(x) - w + 1
                out = p[w][0][x[:n]]
                for j in range(1, w):
                    out = out + p[w][j][x[j:j + n]]
                best[w] = out.argmax(axis=0)
                pooled.append(np.take_along_axis(out, best[w][None], axis=0)[0])
            raw = np.concatenate(pooled, axis=1) + p["b"]
            hidden = np.maximum(raw, 0)
            logits = hidden @ p["d"] + p["c"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            err = prob
            err[np.arange(len(y)), y] -= 1
            err /= len(y)
            back = (err @ p["d"].T) * (raw > 0)
            g = {"d": hidden.T @ err, "c": err.sum(axis=0), "b": back.sum(axis=0)}
            rows = np.arange(len(y))[:, None]
            for k, w in enumerate(widths):
                g[w] = np.zeros_like(p[w])
                part = back[:, k * n_filters:(k + 1) * n_filters]
                for j in range(w):
                    np.add.at(g[w][j], (x[best[w] + j, rows], cols[None]), part)
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-7)
    return ByteCnn(langs, {w: p[w] for w in widths}, p["b"], p["d"], p["c"])


def _logits(model: ByteCnn, tables, windows: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(windows.T).astype(np.intp)
    pair = np.concatenate([x[:-1] * 256 + x[1:], x[-1:] * 256])
    pooled = []
    for w, parts in tables:
        n, out = len(x) - w + 1, None
        for j, table in parts:
            got = table[pair[j:j + n]]
            out = got if out is None else np.add(out, got, out=out)
        pooled.append(out.max(axis=0))
    return np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0) @ model.dense + model.dense_bias


def predict(model: ByteCnn, tables, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its probability) of each non-empty text."""
    total = np.zeros((len(texts), len(model.langs)))
    counts = [-(-len(t) // WINDOW) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    data = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts)), np.uint8)
    windows = data.reshape(-1, WINDOW)
    weight = np.count_nonzero(windows, axis=1)
    for k in range(0, len(windows), 64):
        part = _logits(model, tables, windows[k:k + 64]) * weight[k:k + 64, None]
        np.add.at(total, owner[k:k + 64], part)
    total /= np.maximum(np.bincount(owner, weight, len(texts)), 1)[:, None]
    prob = np.exp(total - total.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    return prob.argmax(axis=1), prob.max(axis=1)


def language_sample(docs: DataFrame, usable: Column, *, text_col: str = "text", lang_col: str = "lang",
                    per_lang: int = 1500, most: int = 400_000) -> DataFrame:
    """(lang, h, cut): a window of each text with the ``per_lang`` lowest hashes of its language, equal
    texts once; fewer a language, at least one, where all would be more than ``most``."""
    place = F.pmod("h", F.lit(1 << 30))
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # distinct texts by language, so that copies don't count; one row per language
    texts = written(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts")))
    each = max(1, min(per_lang, most // max(1, texts.count())))
    # far more than needed pass this filter, all of a small language; the window takes the lowest
    low = rows.join(texts, "lang").where(place < F.least(F.lit(1.0), (2.0 * each + 40) / F.col("texts")) * (1 << 30))
    spare = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("h"), spare.cast("long")) + 1).cast("int")
    cut = F.substring(F.col("text").cast("binary"), start, F.lit(WINDOW))
    once = low.select("lang", "h", cut.alias("cut")).groupBy("lang", "h").agg(F.min("cut").alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    return once.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "h", "cut")


def fit_language_model(docs: DataFrame, usable: Column, *, text_col: str = "text", lang_col: str = "lang",
                       per_lang: int = 1500, most: int = 400_000) -> ByteCnn | None:
    """Train on a window of ``per_lang`` distinct texts of each language among the ``usable``
    rows (fewer a language where there are very many, see ``language_sample``: ``most`` bounds the
    sample at any corpus size). Every language is learned. Texts are chosen by their hash, so the sample is
    the same in every run. None when no row is usable."""
    sample = language_sample(docs, usable, text_col=text_col, lang_col=lang_col, per_lang=per_lang, most=most)
    rows = sample.orderBy("h", "lang").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    windows = np.frombuffer(b"".join(bytes(r["cut"]).ljust(WINDOW, b"\0") for r in rows), np.uint8)
    return train(windows.reshape(-1, WINDOW), np.array([place[r["lang"]] for r in rows]), langs)


def language_of(model: ByteCnn | None, text_col: str = "text") -> Column:
    """struct(lang, score) of a text: the predicted language and its probability.

    ``und`` with score 0 where the text is null, has no letter, or there is no
    model (no labelled rows). Only the text is looked at."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown

    @F.pandas_udf("lang string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.pair_tables()
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            texts = [t or b"\0" for t in batch]
            at, probs, group, size = [], [], [], 0
            for k, t in enumerate(texts):          # about 4 MB of windows at a time
                group.append(t)
                size += len(t)
                if size > 1 << 22 or k == len(texts) - 1:
                    a, p = predict(model, tables, group)
                    at.append(a)
                    probs.append(p)
                    group, size = [], 0
            at = np.concatenate(at) if at else np.zeros(0, int)
            yield pd.DataFrame({"lang": names[at], "score": np.concatenate(probs) if probs else np.zeros(0)})

    found = udf(F.col(text_col).cast("binary"))
    return F.when(F.col(text_col).rlike(LETTER), found).otherwise(unknown)

"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes for good (1), for bad (-1) or abstains (0). How far a rule can be trusted is
estimated without labels: expectation-maximisation alternates between each vote
pattern's probability of being good and the rules' accuracies under these
probabilities. A document is kept by its posterior probability, so that one rule's
verdict can be outvoted, instead of having to pass every rule.

A text is read once. What the estimation works on is a table of vote patterns and their
numbers, at most 3 to the number of rules whatever the corpus, and each round is one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, written

WINDOW = 5                   # words of a repeated window


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """How many words the windows at the ascending ``starts`` cover: each its own, up to the next start."""
    end = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, at: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), at - s["last"])).cast("int").alias("n"), at.cast("int").alias("last")))
    return end["n"]


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of five words found twice or more in the text. Windows are
    compared by a 64-bit hash of their words. Only texts with a repeated window sort theirs."""
    def counted(hashes: Column) -> Column:
        in_order = F.array_sort(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

        def repeated(s: Column) -> Column:
            marked = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return _covered(F.array_sort(F.transform(marked, lambda x: x["at"])))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(in_order, repeated))

    def hashed(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(_let(window, counted))

    return hashed(words).cast("long")


def text_counts(text_col: str = "text") -> Column:
    """Struct of counts of a whole text (null: no words): ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines`` (lines with a word), ``n_letters`` and ``n_ended`` (lines that end a sentence)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        ended = F.filter(lines, lambda x: x.rlike(rf"[.!?]{WHITE}*\z"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.size(ended).cast("long").alias("n_ended"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    both = F.struct(words.alias("w"), lines.alias("l"))
    return _let(both, lambda b: F.struct(
        b["w"]["n_words"].alias("n_words"), F.char_length(F.regexp_replace(text, f"{WHITE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), b["l"]["n_dup_lines"].alias("n_dup_lines"),
        b["w"]["n_repeat_words"].alias("n_repeat_words"), b["l"]["n_lines"].alias("n_lines"),
        F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"), b["l"]["n_ended"].alias("n_ended")))


#: Rule -> (votes for good where, votes for bad where), over the counts. Integers only, so that every engine agrees.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 30", "n_words < 15"),
    "word_size": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "repeats": ("20 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    "lines": ("n_dup_lines = 0", "5 * n_dup_lines > n_lines"),
    "letters": ("10 * n_letters >= 8 * word_chars", "10 * n_letters < 6 * word_chars"),
    "ends": ("2 * n_ended >= n_lines", "n_ended = 0 AND n_lines >= 3"),
}

ROUNDS, PRIOR_RIGHT, PRIOR_VOTES, LEAST, MOST = 20, 8.0, 10.0, 0.55, 0.98


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents and each rule's accuracy where it votes."""

    good: float
    accuracy: tuple[float, ...]
    rules: tuple[str, ...]

    def posterior(self) -> Column:
        """Probability of good, from columns that hold each rule's vote."""
        return posterior(F.lit(self.good), [F.lit(a) for a in self.accuracy], [F.col(r) for r in self.rules])


def posterior(good: Column, accuracy: list[Column], votes: list[Column]) -> Column:
    odds = F.ln(good / (1 - good))
    for a, v in zip(accuracy, votes):
        odds = odds + v * F.ln(a / (1 - a))
    return 1 / (1 + F.exp(-odds))


def votes(rules: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Each rule's vote; a text without words makes every rule abstain."""
    return {f"vote_{name}": F.when(F.expr(f"n_words > 0 AND ({good})"), 1).when(F.expr(f"n_words > 0 AND ({bad})"), -1).otherwise(0)
            for name, (good, bad) in rules.items()}


def fit_rules(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> RuleModel:
    """Expectation-maximisation over ``patterns`` (one column of votes per rule, ``n`` documents).

    A rule that votes is right with its accuracy, for good and bad documents alike, independently of
    the others. Accuracies start at 0.8, which is also their prior (worth ten votes), and stay between
    0.55 and 0.98, so that a rule is never turned round or believed blindly; the share of good
    documents starts at a half and stays between 0.05 and 0.95. An empty table keeps the start."""
    good, accuracy = 0.5, [PRIOR_RIGHT / PRIOR_VOTES] * len(names)
    cols = [F.col(c) for c in names]
    for _ in range(rounds):
        p = posterior(F.lit(good), [F.lit(a) for a in accuracy], cols)
        right = [F.sum(F.col("n") * F.when(c == 1, F.col("p")).when(c == -1, 1 - F.col("p")).otherwise(0.0)) for c in cols]
        cast = [F.sum(F.col("n") * F.abs(c)) for c in cols]
        row = patterns.withColumn("p", p).agg(F.sum("n"), F.sum(F.col("n") * F.col("p")), *right, *cast).first()
        if row[0] is None:
            break
        good = min(0.95, max(0.05, row[1] / row[0]))
        accuracy = [min(MOST, max(LEAST, (PRIOR_RIGHT + row[2 + k]) / (PRIOR_VOTES + row[2 + len(names) + k])))
                    for k in range(len(names))]
    return RuleModel(good, tuple(accuracy), tuple(names))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                        rules: Mapping[str, tuple[str, str]] = RULES, least: float = 0.5) -> tuple[DataFrame, RuleModel]:
    """Per row of ``docs``: ``id_col``, the counts, ``base_failed``, a ``vote_...`` per rule, ``posterior``
    and ``kept``; and the fitted model.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated five-word windows; such
    documents are not kept whatever the posterior, but count in the estimation. Null, empty and blank
    texts have no words and fail. Repeated rows and rows without an id count like any other. Other columns
    are not looked at; an empty table gives no rows. ``rules`` are SQL conditions over the counts.
    """
    names = list(votes(rules))
    counted = docs.select(F.col(id_col).alias("_id"), text_counts(text_col).alias("c")).select("_id", "c.*")
    rows = written(counted.withColumns(votes(rules)))
    model = fit_rules(written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))), names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumns({"base_failed": failed, "posterior": model.posterior()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).withColumnRenamed("_id", id_col), model

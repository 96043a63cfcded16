"""The corpus pipeline: five operators of ``civicflow.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. Extra columns pass through; null and empty texts,
null ids and repeated rows are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.common import fold, n_words, unused, written
from civicflow.llm.langid import UNKNOWN, fit_language_model, language_of
from civicflow.llm.line_dedup import drop_repeated_lines
from civicflow.llm.mixing import balance, row_hash, with_copies, with_numbers
from civicflow.llm.packing import pack_documents
from civicflow.llm.queries import tokenizer_file
from civicflow.llm.simhash import one_of_each_group
from civicflow.sources.tables import read_table

LEAST_SCORE = 0.5            # below this, no language is likelier than all others together


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows: texts without a letter
    (null and empty ones too) and texts of which it is not sure go."""
    usable = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    found = docs.select(F.struct("*").alias("doc"), language_of(fit_language_model(docs, usable)).alias("found"))
    return found.where((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated line runs of 50 words or more deleted from
    their texts; ``n_chars`` follows the text where it is there."""
    removed = unused("removed", docs.columns)
    cut = drop_repeated_lines(docs, min_words=50, removed_col=removed)
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size(removed) > 0, size).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id. Rows without
    an id are linked like any other and stay where no row with an id is in their group."""
    return one_of_each_group(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 2 rows for each."""
    # the stored documents, so that a row has the same number in every scan; they need not be written again
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    mix = balance(rows, "doc.doc_id", "doc.source", "doc.text", weights=(5.0, 2.0, 1.0), budget=1.5, cap=2, row=F.col("row"))
    keys = rows.select("doc", "row", F.col("doc.source").alias("source"), n_words("doc.text").alias("size"),
                       row_hash("doc.doc_id", "doc.text").alias("h"))
    taken = with_copies(with_numbers(keys, mix.numbers), mix).where("copies > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path=tokenizer_file(), size=2048, cached_words=100_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: Training a network, solving a dual and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

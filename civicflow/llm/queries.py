"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.sources.tables import read_table

from .align import align_documents, digest
from .chat import digests, format_conversations, probe, read_back
from .common import fold
from .exact_dedup import normalised, progressive_exact_dedup
from .langid import fit_language_model, language_of
from .line_dedup import drop_repeated_lines
from .mixing import mix_sources
from .packing import pack_documents
from .quality import fit_quality, quality_score
from .quality_rules import LEAST, MOST, PRIOR_RIGHT, PRIOR_VOTES, ROUNDS, RULES, apply_quality_rules
from .simhash import simhash_groups
from .topk import top_inner_products
from .toxicity import fit_toxicity, toxicity_score
from .vector_codes import books_digest, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op4_exact_dedup", """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
           FROM documents),
     w AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST) AS keep_id,
                  row_number() OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST) AS place
           FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return progressive_exact_dedup(docs, carry={"text_sha256": F.sha2(normalised(), 256)})


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = simhash_groups(docs, shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = fit_language_model(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), language_of(model).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


@query("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), budget=1.5, cap=2)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_file())


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op5_line_dedup", r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
     trimmed AS (SELECT *, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM raw),
     l AS MATERIALIZED (
       SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k,
              sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY line) AS upto,
              len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words
       FROM trimmed WHERE t <> ''),
     pairs AS (SELECT a.doc_id, a.k AS s, b.k AS e FROM l a JOIN l b
               ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto - a.upto + a.words >= 50),
     windows AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY ALL UNION SELECT doc_id, max(s), e FROM pairs GROUP BY doc_id, e),
     named AS (SELECT w.doc_id, w.s, w.e, md5(string_agg(l.t, chr(10) ORDER BY l.k)) AS name
               FROM windows w JOIN l ON l.doc_id = w.doc_id AND l.k BETWEEN w.s AND w.e GROUP BY ALL),
     firsts AS (SELECT name, min({'d': doc_id, 's': s}) AS f FROM named GROUP BY name),
     later AS (SELECT n.* FROM named n JOIN firsts USING (name)
               WHERE f < {'d': n.doc_id, 's': n.s} AND (f.d <> n.doc_id OR f.s + n.e - n.s < n.s)),
     gone AS (SELECT DISTINCT l.doc_id, l.line FROM later w JOIN l ON l.doc_id = w.doc_id AND l.k BETWEEN w.s AND w.e)
SELECT r.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
       coalesce(list(CAST(r.line AS INTEGER) ORDER BY r.line) FILTER (WHERE g.line IS NOT NULL), []) AS removed_lines,
       sha256(coalesce(string_agg(r.x, chr(10) ORDER BY r.line) FILTER (WHERE g.line IS NULL), '')) AS text_sha256
FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.line = r.line GROUP BY r.doc_id
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, the numbers of those deleted, and the digest of what is left."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    cut = drop_repeated_lines(docs, min_words=50)
    return cut.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    model = fit_toxicity(docs, labels, ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = fit_quality(docs, labels, ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op9_exact_topk", """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op10_chat_format", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, role || chr(10) || text || chr(10) AS line,
                  regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS r,
                  regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS x
           FROM t),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST, role, text) AS lines,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (WHERE role = 'assistant'), '') AS loss,
                  CAST(3 + sum(length(r) + length(x) + 21) AS BIGINT) AS formatted_chars
           FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM g
""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(turns.unionByName(probe(turns)))
    return digests(read_back(formatted))


@query("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(read_table(spark, sf_dir, "documents"), byte_bpe=tokenizer_file(),
                              piece_model=tokenizer_file("piece_bpe_32k.model"), show=digest)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def _rules_sql() -> str:
    """The counts, the votes and the rounds of the estimation written out one after the other."""
    names = [f"vote_{r}" for r in RULES]
    vote = ",\n       ".join(f"CASE WHEN n_words > 0 AND ({g}) THEN 1 WHEN n_words > 0 AND ({b}) THEN -1 ELSE 0 END AS vote_{r}"
                             for r, (g, b) in RULES.items())
    odds = " + ".join(["ln(g / (1 - g))", *[f"{v} * ln(a{k} / (1 - a{k}))" for k, v in enumerate(names)]])
    sql = [f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
x AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT r, g FROM x GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM x JOIN twice USING (r, g), range(5) AS o(k) GROUP BY r),
l AS (SELECT r, [y FOR y IN string_split(text, chr(10)) IF regexp_matches(y, '[^\\x20\\x09-\\x0D]')] AS l FROM t),
c AS MATERIALIZED (SELECT t.r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
       coalesce(repeats.n, 0) AS n_repeat_words, len(l) AS n_lines,
       length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
       len([y FOR y IN l IF regexp_matches(y, '[.!?][\\x20\\x09-\\x0D]*\\z')]) AS n_ended
       FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN repeats USING (r)),
v AS MATERIALIZED (SELECT *, {vote} FROM c),
p AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM v GROUP BY ALL),
m0 AS (SELECT 0.5::DOUBLE AS g, {", ".join(f"{PRIOR_RIGHT / PRIOR_VOTES}::DOUBLE AS a{k}" for k in range(len(names)))})"""]
    for k in range(ROUNDS):
        right = ", ".join(f"least({MOST}, greatest({LEAST}, ({PRIOR_RIGHT} + sum(n * CASE {v} WHEN 1 THEN post WHEN -1 THEN 1 - post ELSE 0.0 END))"
                          f" / ({PRIOR_VOTES} + sum(n * abs({v})))))::DOUBLE AS a{i}" for i, v in enumerate(names))
        sql.append(f"""m{k + 1} AS MATERIALIZED (SELECT least(0.95, greatest(0.05, sum(n * post) / sum(n)))::DOUBLE AS g, {right}
      FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS post FROM p, m{k}))""")
    return ",\n".join(sql) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v), m{ROUNDS}"""


@query("op12_quality_rules", _rules_sql())
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = apply_quality_rules(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op13 written out one after the other."""
    sql = ["""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
      FROM embeddings WHERE embedding IS NOT NULL
        AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
c AS MATERIALIZED (SELECT r, (j - 1) // (n // 8) AS part, j, x FROM (
      SELECT r, len(q) AS n, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM v)),
seed AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v),
b0 AS MATERIALIZED (SELECT part, e, j, x FROM c JOIN seed USING (r) WHERE e < 16)"""]
    for k in range(rounds + 1):
        sql.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': e}}) AS m FROM (
      SELECT r, part, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b{k} b USING (part, j) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            sql.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, b.j,
      CAST(coalesce((s - ((s % n) + n) % n) // n, b.x) AS BIGINT) AS x FROM b{k} b LEFT JOIN (
        SELECT part, a.m.e AS e, j, sum(x) AS s, count(*) AS n FROM a{k} a JOIN c USING (r, part) GROUP BY ALL) t USING (part, e, j))""")
    sql.append(f"""o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
      FROM a{rounds} GROUP BY r)""")
    return ",\n".join(sql) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN o USING (r)"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(read_table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(books_digest(books)).alias("codebooks_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

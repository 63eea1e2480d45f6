"""The thin queries op1 to op13 and the pipeline: (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import crc_column, table

#: Where the vocabulary files lie; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("SIFTSTONE_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import fingerprints

    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), packing.word_bpe(vocabulary("word_bpe_49k.json")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import language_id

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_column(), F.lit(4)) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftstone.llm import token_counts

    counter = token_counts.byte_bpe(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), counter)


def op6_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import sentencepieces

    return sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import lm_scoring

    held_out = F.pmod(crc_column(), F.lit(5)) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return lm_scoring.score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import html_extraction

    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import line_dedup

    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_counts=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import periodic_runs

    docs = periodic_runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, "planted", ["doc_id"]))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import top_products

    return top_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


TOP_PRODUCTS_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import source_divergence

    return source_divergence.divergence(table(spark, sf_dir, "documents"))


SOURCE_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurrences AS (SELECT lang, source, d, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(DISTINCT d) AS docs, count(*) AS n FROM occurrences GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY ALL),
pairs_of AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0)::BIGINT AS total
  FROM pairs_of g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source LEFT JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + v.v) AS p,
    1 + 1000000000 * (k.lang_n + 1) // (v.lang_total + v.v) AS q
  FROM totals t JOIN v USING (lang) JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepieces": op6_sentencepieces,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_top_products": op12_top_products,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op12_top_products": TOP_PRODUCTS_SQL, "op13_source_divergence": SOURCE_DIVERGENCE_SQL}

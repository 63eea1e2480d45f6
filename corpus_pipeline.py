"""The corpus pipeline: language ID, quality rules, line dedup, near-dedup, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last one with the columns of docs. Stages are
written as Parquet between each other, by the caller or by run().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import language_id as _language_id
from siftstone.llm import line_dedup as _line_dedup
from siftstone.llm import near_dedup as _near_dedup
from siftstone.llm import packing as _packing
from siftstone.llm import quality_rules as _quality_rules
from siftstone.llm.common import stored, table
from siftstone.llm.queries import vocabulary

#: Texts with a word in the sense of the operators.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A language is believed from this posterior on.
MIN_SCORE = 0.5


def _whole(docs: DataFrame) -> DataFrame:
    """A document's row as one column beside its text: no column of it can clash with one that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones speak; a text without letters, or of no clear language, goes."""
    model = _language_id.train(docs)
    told = _language_id.predict(_whole(docs), model, ["__row"])
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("__row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the base nor the learned list rejects."""
    rules = _quality_rules.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _quality_rules.judge(_whole(docs), rules).filter("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document that has no word left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    apart = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    left = _line_dedup.dedup_lines(apart).filter(F.col("text").rlike(HAS_WORD))
    size = F.length("text").cast("long")
    return left.select(*[c if c in ("doc_id", "text") else size.alias(c) if c == "n_chars" else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    It is that of the least id, and of the least hash among rows of that id; a null id is never less than another. Rows are told
    apart by 96 bits of hash over id and text, so another text with the id of a copy stays. Texts cross one shuffle, copies within a task
    fall together before it. A document without a word is nobody's copy and stays.
    """
    key = [F.xxhash64("doc_id", "text").alias("__h"), F.hash("doc_id", "text").cast("long").alias("__i")]
    told = _near_dedup.near_duplicates(docs.select("doc_id", "text", *key), width=5, percent=80, carry=["__h", "__i"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__i")).alias("least")
    kept = told.filter("component is not null").groupBy("component").agg(least).select("least.__h", "least.__i")
    has_word = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    rows = _whole(docs).withColumn("__has", has_word).select("*", *[F.expr(e) for e in ("xxhash64(__row.doc_id, text) as __h", "cast(hash(__row.doc_id, text) as bigint) as __i")])
    one = rows.filter("__has").dropDuplicates(["__h", "__i"]).join(kept.hint("merge"), ["__h", "__i"], "left_semi")
    return one.select("__row.*").union(rows.filter("not __has").select("__row.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return _packing.pack(docs, _packing.word_bpe(vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Language ID, learned rules and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

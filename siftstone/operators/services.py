"""Collections of embedded chunks, and evidence that is retrieved once and then stays what it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import evidence as ev
from siftstone.operators.models import Embedder, embed, same_signature
from siftstone.session import exists, remove


class Collection:
    """A table of embedded texts at a path, under the signature of the model that made it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.rows().count() if self.exists() else 0

    def reset(self) -> bool:
        """Removes the collection; whether there was one."""
        return remove(self.spark, self.path)

    def build(self, rows: DataFrame, model: Embedder, key: str, text: str, split: str = "train", most_words: int = 512) -> DataFrame:
        """Embeds the rows of the train split and appends those whose key is not there: one row before, after, added, truncated.

        rows: key, text, split. Another model than the stored one, and an empty text, fail before anything is written. truncated counts the
        texts of more words than the model reads.
        """
        wanted = rows.filter(F.col("split") == split).select(key, F.when(F.trim(text) != "", F.col(text)).otherwise(F.raise_error(F.lit("an empty text")).cast("string")).alias(text))
        before = self.count()
        if before:
            same_signature(self.rows(), model)
            wanted = wanted.join(self.rows().select(key), key, "left_anti")
        words = F.size(F.split(F.trim(text), r"\s+"))
        made = embed(wanted, model, key, text).join(wanted.select(key, (words > most_words).alias("truncated")), key)
        made.write.mode("append").parquet(self.path)
        after = self.rows()
        told = after.agg(F.count("*").alias("after"), F.count_if("truncated").alias("truncated"))
        return told.select(F.lit(before).cast("long").alias("before"), "after", (F.col("after") - before).alias("added"), "truncated")

    def scroll(self, key: str, size: int = 128) -> Iterator[list[Row]]:
        """All rows in order of the key, in lists of `size`: one partition at a time is with the driver."""
        batch: list[Row] = []
        for row in self.rows().orderBy(key).toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch


class EvidenceService:
    """Retrieves evidence for a set of queries once; from then on the stored snapshot answers, whatever becomes of the corpus."""

    def __init__(self, spark: SparkSession, path: str, search: Callable[[], DataFrame]):
        self.spark, self.path, self.search = spark, path, search

    def retrieve(self) -> DataFrame:
        """query_id, source_id, rank, text_sha of the frozen hits."""
        if not exists(self.spark, self.path):
            self.search().write.mode("errorifexists").parquet(self.path)
        return self.spark.read.parquet(self.path)

    def snapshots(self) -> DataFrame:
        """query_id, n_rows, snapshot_id: the identity of each query's evidence."""
        return ev.snapshot(self.retrieve(), ["query_id"], "rank", "source_id", "text_sha")


def state_of(case: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """key, ref, text: the state that a case gives as it stands, each fact of the named array columns under its reference."""
    out = None
    for name in facts:
        rows = case.select(key, F.posexplode(name).alias("i", "text")).select(key, F.concat(F.lit(f"patient:{name}:"), F.col("i").cast("string")).alias("ref"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def attached(document: Column, name: str, part: Column, valid: Column) -> Column:
    """A document (struct) with one field replaced by a part that is valid; an invalid part fails, and no other field changes."""
    return document.withField(name, F.when(valid, part).otherwise(F.raise_error(F.lit(f"invalid {name}"))))


def model_memory(config: dict, weight_bytes: int, most_bytes: int = 500_000_000) -> dict:
    """A cautious estimate for one scalar cross-encoder of the base size: two copies of its 32-bit weights, and 1.25 GB to work in."""
    h, layers = config["hidden_size"], config["num_hidden_layers"]
    if (h, layers, config.get("intermediate_size"), config.get("num_attention_heads"), config.get("max_position_embeddings")) != (768, 12, 3072, 12, 512):
        raise ValueError("not of the base size")
    embeddings = (config["vocab_size"] + 512 + config.get("type_vocab_size", 2)) * h + 2 * h
    parameters = embeddings + layers * (12 * h * h + 13 * h) + h * h + 2 * h + 1
    if not 0 < weight_bytes <= most_bytes:
        raise ValueError("weights of no sound size")
    return {"parameters": parameters, "weights_gb": parameters * 4 / 1e9, "peak_gb": 2 * max(weight_bytes, parameters * 4) / 1e9 + 1.25}

"""Seams for models: anything with a signature that embeds texts or scores pairs, run once per worker over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    signature: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    signature: str

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEmbedder:
    """Deterministic stand-in without a model: signed word hashes, normalised. Where the signs of a text's words cancel to nothing, they count without signs."""

    def __init__(self, size: int = 384):
        self.size, self.signature = size, f"hashing-v1:{size}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for i, text in enumerate(texts):
            hashes = [zlib.crc32(w.encode("utf-8", "replace")) for w in (text or "").lower().split()]
            for h in hashes:
                out[i, h % self.size] += 1.0 if h >> 31 else -1.0
            if not out[i].any():
                for h in hashes:
                    out[i, h % self.size] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class LexicalScorer:
    """Deterministic stand-in for a cross-encoder: shared words over the query's words, less a half."""

    signature = "lexical-v1"

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, p in pairs:
            a, b = set((q or "").lower().split()), set((p or "").lower().split())
            out.append(len(a & b) / max(1, len(a)) - 0.5)
        return out


def embed(rows: DataFrame, model: Embedder, key: str, text: str) -> DataFrame:
    """key, embedding, signature."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model.embed(s.tolist())))

    return rows.select(key, run(F.col(text)).alias("embedding"), F.lit(model.signature).alias("signature"))


def cross_score(pairs: DataFrame, model: PairScorer, query: str, passage: str, name: str = "logit") -> DataFrame:
    """pairs with the model's score; a score that is not finite fails the step."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            scores = pd.Series(model.score(list(zip(q, p, strict=True))), dtype=float)
            if not np.isfinite(scores).all():
                raise ValueError("a score that is not finite")
            yield scores

    return pairs.withColumn(name, run(F.col(query), F.col(passage)))


def same_signature(stored: DataFrame, model: Embedder) -> None:
    """Refuses to search vectors that another model made."""
    other = stored.select("signature").distinct().filter(F.col("signature") != model.signature).take(1)
    if other:
        raise ValueError(f"stored under {other[0]['signature']}, asked for {model.signature}")

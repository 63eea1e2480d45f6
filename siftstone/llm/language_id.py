"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows (PER_LANGUAGE documents of each language at most, chosen
by a hash of the id); tasks add up their own counts before the shuffle. The log-probability matrix has BUCKETS rows
and a column for each language, and is broadcast; more than LANGUAGES languages (256 MB) are an error, never cut. Scoring turns a batch of texts into one
array of hashed n-grams in numpy, gathers the matrix rows and adds them up by document; long texts are
walked through in pieces, so memory is bounded and whole texts count.

Defined results: a null text, and one without a letter, is `und` with score 0, as is every text where nothing was learned; ties
go to the alphabetically first language; repeated rows get the same result; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, portions

BUCKETS, PER_LANGUAGE, LANGUAGES, SIZES, PIECE = 1 << 16, 4000, 1024, (1, 2, 3), 1 << 19
_NEAR_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits, such as ½
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    first = _NEAR_LETTER.search(text)
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # BUCKETS x languages, float32 log probabilities
    prior: np.ndarray


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each size; position i holds the gram that begins at i."""
    c = codes.astype(np.uint64)
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(c) < n:
            return
        with np.errstate(over="ignore"):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * _MIX
        if n in SIZES:
            yield (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, documents, spare): each document lower-cased between blanks.

    A long one comes in pieces; the spare characters at the end of a piece are there for the grams that begin before them.
    """
    docs, parts, spare, size, over = [], [], [], 0, max(SIZES) - 1

    def flush():
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        return np.concatenate(parts), starts, np.array(docs), np.array(spare)

    for k, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
        for at in range(0, len(codes), PIECE):
            part = codes[at : at + PIECE + over]
            docs.append(k)
            parts.append(part)
            spare.append(max(0, len(part) - PIECE))
            size += len(part)
            if size >= PIECE:
                yield flush()
                docs, parts, spare, size = [], [], [], 0
    if parts:
        yield flush()


def outside(size: int, n: int, starts: np.ndarray, spare: np.ndarray, total: int) -> np.ndarray:
    """Of n grams of a size, the positions of those that begin in spare characters or run on into another piece."""
    ends = np.append(starts[1:], total)
    away = np.concatenate([ends[np.maximum(spare, size - 1) >= d] - d for d in range(1, max(SIZES))])
    return away[(away >= 0) & (away < n)]


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with text and language; null languages and texts are left out."""
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values: the matrix of so many would not fit into a broadcast, and none is left out")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= share[F.col("lang")] * (1 << 20))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in portions(batches):
            by: dict[str, list[str]] = {}
            for t, k in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if k in sizes:
                    by.setdefault(k, []).append(t)
            for k, texts in by.items():
                have = seen.setdefault(k, np.zeros(BUCKETS, np.int64))
                for codes, starts, _, spare in pieces(texts):
                    for size, g in zip(SIZES, grams(codes), strict=False):
                        have += np.bincount(np.delete(g, outside(size, len(g), starts, spare, len(codes))), minlength=BUCKETS)
        for k, have in seen.items():
            at = np.flatnonzero(have)
            yield batch(arrow_schema("lang string, bucket int, n long"), [k] * len(at), at.astype(np.int32), have[at])

    got = chosen.select("text", "lang").mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    column = np.array([languages.index(x) for x in got.column("lang").to_pylist()], dtype=int)
    counts[got.column("bucket").to_numpy(), column] = got.column("n").to_numpy()
    counts += 0.5
    # equal priors: a language's share of the corpus says nothing about a text
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.zeros(len(languages)))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    n, k = len(texts), len(model.languages)
    if not k:
        return ["und"] * n, [0.0] * n
    total = np.tile(model.prior, (n, 1)).astype(float)
    live = [t if t is not None and has_letter(t) else None for t in texts]
    at = [i for i, t in enumerate(live) if t is not None]
    for codes, starts, docs, spare in pieces([live[i] for i in at]):
        for size, g in zip(SIZES, grams(codes), strict=False):
            rows = model.matrix[g]
            rows[outside(size, len(g), starts, spare, len(codes))] = 0
            sums = np.add.reduceat(rows, np.minimum(starts, len(g) - 1), axis=0, dtype=float)
            np.add.at(total, np.array(at)[docs], sums)
    best = total.argmax(axis=1)
    with np.errstate(under="ignore"):
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return (
        [model.languages[b] if t is not None else "und" for b, t in zip(best, live, strict=True)],
        [float(s) if t is not None else 0.0 for s, t in zip(score, live, strict=True)],
    )


def predict(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of docs with lang_pred and score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for b in portions(batches):
            pred, score = score_texts(m, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(work, out)

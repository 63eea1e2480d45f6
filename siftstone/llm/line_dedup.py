"""Line dedup by winnowing over line hashes.

1. A text's lines (parted by \\n) that hold a word are its units; lines without one never match and are never deleted by themselves.
   From each unit a window runs on, and another runs back, until it holds MIN_WORDS words. The least line hash of a window is
   selected; neighbouring windows mostly select the same one. A run of equal units that holds MIN_WORDS words holds a whole window,
   so its minimum is selected wherever the run stands: a guaranteed fingerprint.
2. A fingerprint that is selected at one position alone is in no repeated run, and what is around it is done with. The others
   are live. A bitmap of fixed size tells them in a second scan of the texts (it only saves work; false hits change nothing).
3. From each live minimum the match extends both ways over the windows that selected it. Positions that share (fingerprint,
   window) are joined to the first of them in order of (doc_id, unit), a star and never all pairs; runs grow from
   minimum to minimum as their windows overlap. A line that is common in different company matches by its window alone.

So exactly those units go that stand in a run of MIN_WORDS words or more which stood somewhere before; a deleted line has an
equal line that stays.

Texts cross one shuffle, to meet their deletions; before that go 16 bytes for each minimum and some 40 for each window
around a live one. A window that is in a third of all rows is one hot key: its first position comes from a partial aggregation,
and the join of positions with it is split by Spark.

Defined results: a null text stays null, an empty one empty, with no lines removed; rows with the same id and text are one document
and get the same result; texts shorter than MIN_WORDS words never change; an empty table gives no row; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, bits_of, has_bit, portions, stored

MIN_WORDS = 50


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def winnow(text: str, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(least line hash, its unit, hash of the window, first unit, last unit) for every distinct window."""
    hashes, sizes = [], []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        if n := len(line.split()):
            hashes.append(_signed(xxhash.xxh3_64_intdigest(line)))
            sizes.append(n)
    total = np.cumsum([0] + sizes)
    if total[-1] < min_words:
        return []
    on = np.searchsorted(total, total[:-1] + min_words)  # the unit after the window that begins at i
    back = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # the first unit of the one that ends at i
    units = len(sizes)
    spans = {(i, int(e) - 1) for i, e in enumerate(on) if e <= units} | {(int(b), i) for i, b in enumerate(back) if b >= 0}
    whole, out = np.array(hashes, dtype="<i8"), []
    for i, j in spans:
        least = min(hashes[i : j + 1])
        out.append((least, hashes.index(least, i), _signed(xxhash.xxh3_64_intdigest(whole[i : j + 1].tobytes())), i, j))
    return out


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """fingerprint, doc_id, text_hash, unit: the window minima of each text, every position once."""
    schema = "fingerprint long, doc_id long, text_hash long, unit int"
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            rows = [(*m, *key) for *key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True) if text for m in {w[:2] for w in winnow(text, min_words)}]
            for at in range(0, len(rows), 50_000):
                least, unit, doc, text_hash = zip(*rows[at : at + 50_000], strict=True)
                yield batch(shape, least, doc, text_hash, unit)

    return docs.mapInArrow(work, schema)


def drop_units(text: str, gone: list[int]) -> tuple[str, int]:
    """The text without the units of these numbers, and how many lines went."""
    out, unit, gone = [], -1, set(gone)
    for line in text.split("\n"):
        if line.encode("utf-8", "replace").split():
            unit += 1
            if unit in gone:
                continue
        out.append(line)
    return "\n".join(out), len(gone)


POSITIONS = "doc_id long, text_hash long, fingerprint long, window long, unit int, last int"


def positions(docs: DataFrame, live: np.ndarray, min_words: int) -> DataFrame:
    """The windows around those minima whose bit is set in live."""
    shape = arrow_schema(POSITIONS)
    spread = docs.sparkSession.sparkContext.broadcast(live)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = spread.value
        for b in portions(batches):
            rows = [
                (doc, text_hash, least, window, i, j)
                for doc, text_hash, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True)
                if text
                for least, _, window, i, j in winnow(text, min_words)
                if has_bit(live, least)
            ]
            for at in range(0, len(rows), 50_000):
                yield batch(shape, *zip(*rows[at : at + 50_000], strict=True))

    return docs.mapInArrow(work, POSITIONS)


def deletions(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, spans: what goes, for documents from which something goes."""
    place = F.xxhash64("doc_id", "text_hash", "unit")
    found = fingerprints(docs, min_words).select("fingerprint", place.alias("place"))
    live = found.groupBy("fingerprint").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).filter("lo != hi")
    found = stored(positions(docs, bits_of(live, "fingerprint"), min_words), "positions")
    at = F.struct("doc_id", "text_hash", "unit")
    first = found.groupBy("fingerprint", "window").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["fingerprint", "window"]).filter(at != F.col("first"))
    spans = stored(later.select("doc_id", "text_hash", "unit", "last"), "spans")
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("unit", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, with_counts: bool = False) -> DataFrame:
    """docs with the later repeated runs of lines deleted from text; with_counts adds n_lines and n_removed.

    docs has doc_id, text and any other columns, which are kept; n_chars, where there is one, stays as it was.
    """
    names = docs.columns
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    small = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__hash").alias("text_hash"), F.col("text").cast("string").alias("text"))
    gone = stored(deletions(small, min_words), "deletions").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"), F.col("spans").alias("__spans"))
    # a sort-merge join at every size: what a broadcast would save on small tables it could not hold on large ones
    met = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left").drop("__id", "__th", "__hash")

    out = [f for f in met.schema.fields if f.name in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + (["n_lines bigint", "n_removed bigint"] if with_counts else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            texts, lines, removed = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                n = 0
                lines.append(text.count("\n") + 1 if text else 0)
                if spans:
                    text, n = drop_units(text, [u for s in spans for u in range(s["unit"], s["last"] + 1)])
                texts.append(text)
                removed.append(n)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else b.column(f.name) for f in out]
            extra = [pa.array(lines, pa.int64()), pa.array(removed, pa.int64())] if with_counts else []
            yield pa.RecordBatch.from_arrays(columns + extra, names=[f.name for f in out] + ["n_lines", "n_removed"] * with_counts)

    return met.mapInArrow(work, schema)

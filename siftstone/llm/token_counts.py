"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, and summed.

A pre-token is what the vocabulary's own pre-tokenizer cuts, within which alone merges happen: special strings first, then the matches of
its pattern. A text is cut before every run of white space, where the pattern always cuts, and each distinct chunk of a portion
of rows is cut by the pattern once; chunks with characters that the pattern's engines class apart go to the library's own cut. A document
becomes its pre-tokens' frequencies. Frequent pre-tokens, found on a bounded sample (HEAD of them at most, a few MB), have
their counts with every task; that choice is about speed alone. All others meet by pre-token in one shuffle, where the
vocabulary is walked once for each distinct one, and the sums go back to their rows. Ids are never made for a document.

Hot pre-tokens are in the head, so no key of the shuffle holds many rows; rows that wait for nothing are dealt by row.
Pre-tokens of more than LONG characters stay out of the shuffle, so no key is large: a task counts each distinct one once and knows it
again by 128 bits of hash. Rows are numbered by partition and place, which a task that runs again finds as they were: docs is a
table as it is read, or was written before, not the result of a shuffle.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each for itself; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, portions, row_sample
from siftstone.llm.wordbpe import PieceCounter

HEAD, SAMPLE, LONG = 250_000, 20_000, 64
_CHUNK = re.compile(r"\s*\S+|\s+")
#: White space to Python, not to the pre-tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """What stands between the places where every pre-tokenizer of this kind cuts: before runs of white space."""
    return [text] if _ODD.search(text) else _CHUNK.findall(text)


class Cutter(dict):
    """The pre-tokens of chunks. Those of up to size short ones are kept; it starts anew when it is full."""

    def __init__(self, cut: Callable[[str], list[str]], size: int = 100_000):
        super().__init__()
        self.cut, self.size = cut, size

    def __missing__(self, chunk: str) -> list[str]:
        found = self.cut(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.size:
                self.clear()
            self[chunk] = found
        return found

    def frequencies(self, text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        for chunk, f in Counter(chunks(text)).items():
            for piece in self[chunk]:
                out[piece] += f
        return out


class LongCounts(dict):
    """Counts of long pre-tokens by 128 bits of hash, so that no text of them is held."""

    def __init__(self, count: Callable[[str], int], size: int = 100_000):
        super().__init__()
        self.count, self.size = count, size

    def of(self, piece: str) -> int:
        key = xxhash.xxh3_128_digest(piece.encode("utf-8", "replace"))
        if (n := self.get(key)) is None:
            if len(self) >= self.size:
                self.clear()
            n = self[key] = self.count(piece)
        return n


def count_tokens(docs: DataFrame, counter: Callable[[], PieceCounter], limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    counter: makes, in a worker or the driver, what cuts a chunk into pre-tokens (cut) and counts the tokens of one (count).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    head = spark.sparkContext.broadcast(frequent(docs, counter))
    parts_schema = "row long, doc_id long, n_bytes long, piece string, n long"
    shape = arrow_schema(parts_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = head.value, counter()
        cutter, long = Cutter(counts.cut), LongCounts(counts.count)
        for b in portions(batches):
            out: list[tuple] = []
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, have, rest = text or "", 0, []
                for piece, f in cutter.frequencies(text).items():
                    if (n := known.get(piece)) is None:
                        if len(piece) <= LONG:
                            rest.append((row, None, None, piece, f))
                            continue
                        n = long.of(piece)
                    have += f * n
                out.append((row, doc, len(text.encode("utf-8", "replace")), None, have))
                out += rest
                if len(out) > 50_000:
                    yield batch(shape, *zip(*out, strict=True))
                    out = []
            if out:
                yield batch(shape, *zip(*out, strict=True))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last, per = counter().count, None, 0
        for b in portions(batches):
            tokens = []
            for piece, n in zip(b.column("piece").to_pylist(), b.column("n").to_pylist(), strict=True):
                if piece is None:
                    tokens.append(n)
                    continue
                if piece != last:  # rows come sorted: once for each distinct one
                    last, per = piece, count(piece)
                tokens.append(n * per)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], names=["row", "doc_id", "n_bytes", "n_tokens"])

    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, parts_schema)
    met = (
        parts.withColumn("deal", F.when(F.col("piece").isNotNull(), F.xxhash64("piece")).otherwise(F.xxhash64("row")))
        .repartition("deal")
        .sortWithinPartitions("piece")
        .drop("deal")
        .mapInArrow(join, "row long, doc_id long, n_bytes long, n_tokens long")
    )
    return (
        met.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def frequent(docs: DataFrame, counter: Callable[[], PieceCounter], head: int = HEAD, sample: int = SAMPLE) -> dict[str, int]:
    """Counts of the most frequent pre-tokens of a bounded sample of rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        cutter = Cutter(counter().cut)
        shape = arrow_schema("piece string, n long")
        for b in portions(batches):
            for text in b.column("text").to_pylist():
                seen.update({p: n for p, n in cutter.frequencies(text or "").items() if len(p) <= LONG})
                if len(seen) > 500_000:
                    yield batch(shape, list(seen), list(seen.values()))
                    seen.clear()
        yield batch(shape, list(seen), list(seen.values()))

    top = (
        row_sample(docs, sample).select("text").mapInArrow(tally, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "piece").limit(head)
    )
    count = counter().count
    return {p: count(p) for p in top.select("piece").toArrow().column(0).to_pylist()}


def byte_bpe(path: str, ranks_path: str, pattern: str) -> Callable[[], PieceCounter]:
    def make():
        from siftstone.llm.wordbpe import piece_counter

        return piece_counter(path, ranks_path, pattern)

    return make

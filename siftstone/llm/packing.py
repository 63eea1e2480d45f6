"""Packing of examples into sequences by vector bin packing with the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens). One bin is open at a time; of a bounded pool of
waiting examples the one that fits and whose vector has the largest dot product with what the bin has left goes
in next. When none fits, the example with the largest product is cut to fill the bin; the rest of it waits on. A bin
that must close before it is full is cut back to a power of two, and so is what is left at the end of a
partition: there is no padding, and at most a dozen short sequences for each partition.

Work is by input partition: no shuffle, and memory is bounded by the pool. A key, source or group of copies of any
size has no part in how rows are dealt. Ids of sequences hold the partition's number in their high bits.

Defined results: a null or empty text is one token (the end id); repeated rows are packed each for itself; an empty
table gives no row; other columns of the input are ignored; a null id is kept as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, portions


@dataclass
class Item:
    """A waiting piece: ids[start:] of a document's ids; its last `loss` tokens bear loss."""

    doc: object
    ids: np.ndarray
    start: int
    loss: int
    total: int


@dataclass
class VectorPacker:
    """Limits of a sequence: tokens, segments, loss-bearing tokens; pool: examples that wait at most."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    pool: int = 384
    items: list[Item | None] = field(default_factory=list)

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("every limit is at least 1")
        self.sizes = np.zeros((self.pool + 2, 3))
        self.free = list(range(self.pool + 2))
        self.items = [None] * (self.pool + 2)
        self.limits = np.array([self.tokens, self.segments, self.loss], dtype=float)
        self.waiting = 0

    def _put(self, item: Item) -> None:
        k = self.free.pop()
        self.items[k] = item
        n = len(item.ids) - item.start
        self.sizes[k] = n, 1, min(item.loss, n)
        self.waiting += 1

    def _take(self, k: int) -> Item:
        item, self.items[k] = self.items[k], None
        self.sizes[k] = 0
        self.free.append(k)
        self.waiting -= 1
        return item

    def add(self, doc, ids: np.ndarray, loss: int | None = None) -> Iterator[list[tuple[Item, int, int]]]:
        """Yields the sequences that are ready: lists of (item, start, length)."""
        loss, n = len(ids) if loss is None else loss, len(ids)
        item = Item(doc, ids, 0, loss, n)
        if self.loss >= self.tokens:  # whole sequences of a long document need no choice
            while n - item.start >= self.tokens:
                yield [(item, item.start, self.tokens)]
                item.start += self.tokens
        if item.start < n:
            self._put(item)
        while self.waiting > self.pool:
            yield self._bin()

    def finish(self) -> Iterator[list[tuple[Item, int, int]]]:
        while self.waiting:
            yield self._bin()

    def _cut(self, k: int, left: np.ndarray) -> int:
        """Tokens of the front of item k that fit into what is left."""
        item = self.items[k]
        n = len(item.ids) - item.start
        plain = max(0, n - item.loss)
        return int(min(n, left[0], plain + left[2])) if left[1] >= 1 else 0

    def _bin(self) -> list[tuple[Item, int, int]]:
        left, out, used = self.limits.copy(), [], 0
        while left[0] >= 1 and left[1] >= 1 and self.waiting:
            fits = (self.sizes[:, 0] > 0) & (self.sizes <= left).all(axis=1)
            value = (self.sizes / self.limits) @ (left / self.limits)
            if fits.any():
                k = int(np.argmax(np.where(fits, value, -1.0)))
                item = self._take(k)
                n = len(item.ids) - item.start
                took = self._loss_of(item, n)
                out.append((item, item.start, n))
            else:
                k = int(np.argmax(np.where(self.sizes[:, 0] > 0, value, -1.0)))
                if (n := self._cut(k, left)) < 1:
                    break
                item = self._take(k)
                took = self._loss_of(item, n)
                out.append((item, item.start, n))
                self._put(Item(item.doc, item.ids, item.start + n, item.loss, item.total))
            used += n
            left -= (n, 1, took)
        if used < self.tokens and used & (used - 1):
            self._trim(out, used - (1 << used.bit_length() - 1))
        return out

    @staticmethod
    def _loss_of(item: Item, n: int) -> int:
        first_loss = len(item.ids) - item.loss
        return max(0, item.start + n - max(item.start, first_loss))

    def _trim(self, out: list[tuple[Item, int, int]], over: int) -> None:
        """Gives the last `over` tokens back to the pool."""
        back: list[Item] = []
        while over:
            item, start, n = out.pop()
            part = min(over, n)
            rest = next((b for b in back if b.ids is item.ids and b.start == start + n), None)
            if n > part:
                out.append((item, start, n - part))
            if rest:
                rest.start = start + n - part
            else:
                back.append(Item(item.doc, item.ids, start + n - part, item.loss, start + n))
            over -= part
        for b in back:
            end = b.total
            whole = len(b.ids)
            twin = next((k for k, x in enumerate(self.items) if x is not None and x.ids is b.ids and x.start == end), None)
            if twin is not None:  # what was cut off before: join the two again
                self._take(twin)
            elif end != whole:
                raise AssertionError("a gap in a document")
            if not self.free:
                self._grow()
            self._put(Item(b.doc, b.ids, b.start, b.loss, whole))

    def _grow(self) -> None:
        n = len(self.items)
        self.free += range(n, 2 * n)
        self.items += [None] * n
        self.sizes = np.vstack([self.sizes, np.zeros((n, 3))])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]],
    end_id: int = 1,
    limits: tuple[int, int, int] = (2048, 512, 2048),
    with_ids: bool = False,
    prompt: str | None = None,
) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): where it lies in its document and in its sequence.

    encoder: makes, in a worker, the function from a text to its ids. prompt: a column of text that comes first and
    bears no loss. with_ids: adds the piece's ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), VectorPacker(*limits)
        seq = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def lay(sequence):
            nonlocal seq
            at = 0
            for item, start, n in sequence:
                ids = item.ids[start : start + n]
                loss = packer._loss_of(Item(item.doc, item.ids, start, item.loss, 0), n)
                rows.append((item.doc, start, n, zlib.crc32(ids.tobytes()), len(item.ids), seq, at, loss) + ((ids.astype("i4").tolist(),) if with_ids else ()))
                at += n
            seq += 1

        for b in portions(batches):
            texts, before = b.column("text").to_pylist(), b.column("prompt").to_pylist()
            for doc, text, lead in zip(b.column("doc_id").to_pylist(), texts, before, strict=True):
                body = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                ids = np.append(encode(lead), body).astype("<u4") if lead else body
                for sequence in packer.add(doc, ids, len(body)):
                    lay(sequence)
                if len(rows) >= 4096:
                    yield batch(shape, *zip(*rows, strict=True))
                    rows.clear()
        for sequence in packer.finish():
            lay(sequence)
        if rows:
            yield batch(shape, *zip(*rows, strict=True))

    lead = F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lead.alias("prompt")).mapInArrow(work, schema)


def word_bpe(path: str) -> Callable[[], Callable[[str], np.ndarray]]:
    def make():
        from siftstone.llm.wordbpe import word_encoder

        return word_encoder(path).encode

    return make

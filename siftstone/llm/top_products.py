"""Exact top-k inner products by norm-bucketed retrieval: every asked vector against all others.

1. A component x becomes the integer floor(scale * x). One scan gives each vector its length; vectors that are null or hold null or
   non-finite components take no part.
2. Asked vectors and candidates meet on a grid: candidates are dealt over G groups, asked ones over H, and each cell (g, h) is a
   run of one sorted shuffle: first the asked vectors of h, then the candidates of g, longest first. So a cell holds at most QUERY_BYTES of asked vectors
   and streams its candidates. G and H follow from the numbers of rows; candidates go out H times, asked vectors G times.
3. In a cell, candidates come in buckets of like length. The k-th best score t of a query so far gives its local cosine threshold in a bucket,
   c = t / (|q| * greatest length there). Where c > 1 the bucket is left out. Where c is high, coordinate pruning: a candidate whose
   cosine reaches c has each coordinate f within q_f * c -+ sqrt((1 - q_f^2) (1 - c^2)), read off the bucket's sorted
   coordinates for the query's greatest ones. Else length pruning: candidates with |p| >= t / |q|, a prefix of the bucket. What is left is verified by its
   integer product. Bounds are widened by far more than rounding can take away, and ties at t stay in.
4. Each cell gives the k best rows of a query, which merge by a window. A query's own row is told by its number in the scan.

Products are exact: in 32- or 64-bit floats as long as |p| * |q| lies below 2^24 or 2^53, in Python's integers beyond. A score beyond
a long is an error, as is a component beyond one.

Defined results: a null id is a candidate after all others of its score, and never asked; vectors of unlike numbers of components never meet; vectors without components
have scores of 0; of rows that are repeated each counts, as a query and as a candidate, and a query leaves out one row with its id and vector: itself; fewer candidates than k
give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, give_back

#: Rows of a bucket, asked rows that are multiplied at once, and bytes of asked vectors in a cell.
BUCKET, TOGETHER, QUERY_BYTES = 2048, 512, 32 << 20
#: Candidates of a group at least, up to 64 groups; products of a cell at most.
GROUP_ROWS, CELL_PRODUCTS = 6_000, 1 << 33
#: From this local cosine threshold on, coordinates prune; so many coordinates of a query are looked at.
COORDINATES_FROM, FOCUS = 0.9, 4
#: What bounds are widened by, relative to lengths.
SLACK = 1e-9

_ROW = "asked boolean, place long, dims int, norm double, id long, row long, vec binary"


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """asked, place (a number to deal by), dims, norm, id, row (of an asked vector: its own number), vec: 64- or 16-bit integers. Asked rows come twice."""
    shape = arrow_schema(_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            rows: list[tuple] = []
            for vec_id, value, asked in zip(b.column("id").to_pylist(), b.column("vector"), b.column("asked").to_pylist(), strict=True):
                seen += 1
                if not value.is_valid or value.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(value.values, dtype=np.float64))
                if not np.isfinite(x).all():
                    continue
                most = np.abs(x).max(initial=0.0)
                if most >= 2.0**63:
                    raise ValueError("a component is beyond a long")
                norm = most and most * float(np.sqrt(((x / most) ** 2).sum()))
                row = (first + seen, len(x), norm, vec_id, first + seen, x.astype("<i2" if most < 1 << 15 else "<i8").tobytes())
                rows.append((False, *row))
                if asked:
                    rows.append((True, *row))
            if rows:
                yield batch(shape, *zip(*rows, strict=True))

    return vectors.mapInArrow(work, _ROW)


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    """Integer rows of either width as one matrix."""
    wide = [np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<i8") for r in rows]
    return np.stack(wide).astype(np.int64) if dims else np.zeros((len(rows), 0), dtype=np.int64)


class Bucket:
    """Candidates of like length, longest first; sorted coordinates are made for those that a query looks at."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, matrix: np.ndarray):
        self.rows, self.ids, self.norms, self.matrix, self.sorted = rows, ids, norms, matrix, {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            values = self.matrix[:, f] / np.where(self.norms > 0, self.norms, 1.0)
            order = np.argsort(values)
            self.sorted[f] = values[order], order
        return self.sorted[f]

    def within(self, unit: np.ndarray, c: float) -> np.ndarray:
        """The rows that can have a cosine of c or more with a unit vector, by its greatest coordinates."""
        left = None
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            values, order = self.coordinate(f)
            u = float(unit[f])
            apart = np.sqrt(max(0.0, 1 - u * u) * max(0.0, 1 - c * c))
            # beyond the point where the best cosine is reached the bound is that of the unit sphere
            low = -1.0 if -u >= c else u * c - apart
            high = 1.0 if u >= c else u * c + apart
            rows = order[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, side="right")]
            left = rows if left is None else np.intersect1d(left, rows, assume_unique=True)
            if not len(left):
                break
        return np.arange(len(self.ids)) if left is None else left


class Search:
    """The best scores of one cell's queries."""

    def __init__(self, rows: list[int], ids: list[int], norms: list[float], matrix: np.ndarray, keep: int):
        self.rows, self.ids, self.keep, self.matrix = rows, ids, keep, matrix
        self.norms = np.array(norms, dtype=np.float64)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in rows]  # (-score, null id last, id)
        self.least = np.full(len(rows), -np.inf)  # the score that a candidate must reach

    def add(self, q: int, bucket: Bucket, at: np.ndarray, scores: np.ndarray) -> None:
        """Rows of a bucket that reach what q asks for; its own row is none of them."""
        rows = zip(bucket.rows[at].tolist(), bucket.ids[at].tolist(), scores.tolist(), strict=True)
        self.best[q] = sorted(self.best[q] + [(-int(s), i is None, i or 0) for row, i, s in rows if row != self.rows[q]])[: self.keep]
        if len(self.best[q]) == self.keep:
            self.least[q] = -self.best[q][-1][0]

    def meet(self, bucket: Bucket) -> None:
        longest = bucket.norms[0]
        room = self.norms * longest * (1 + SLACK)
        open_ = self.least <= room  # a local threshold beyond 1 closes the bucket
        reach = self.least > COORDINATES_FROM * room
        kind = np.float32 if (top := float(self.norms.max(initial=0.0)) * longest) < 1 << 24 else np.float64 if top < 1 << 53 else object
        asked, told = self.matrix.astype(kind), bucket.matrix.astype(kind)
        for q in np.flatnonzero(open_ & reach & (self.norms > 0)).tolist():
            c = min(1.0, self.least[q] / room[q])
            rows = bucket.within(self.matrix[q] / self.norms[q], c)
            scores = told[rows] @ asked[q]
            good = scores >= self.least[q]
            if good.any():
                self.add(q, bucket, rows[good], scores[good])
        rest = np.flatnonzero(open_ & ~(reach & (self.norms > 0)))
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((self.norms[some] > 0) & (self.least[some] > 0), self.least[some] / self.norms[some], 0.0)
            size = int(np.searchsorted(-bucket.norms, -shortest.min() * (1 - SLACK), side="right"))
            if not size:
                continue
            scores = asked[some] @ told[:size].T
            need = self.least[some]
            if (from_top := size - self.keep - 1) > 0 and kind is not object and np.isinf(need).any():  # at first: the best of this bucket, with room for the own row
                need = np.maximum(need, np.partition(scores, from_top, axis=1)[:, from_top])
            hits = scores >= need[:, None]
            for k in np.flatnonzero(hits.any(axis=1)).tolist():
                here = np.flatnonzero(hits[k])
                self.add(int(some[k]), bucket, here, scores[k, here])

    def rows_of_best(self) -> Iterator[tuple]:
        for row, query, best in zip(self.rows, self.ids, self.best, strict=True):
            for score, none, vec_id in best:
                yield row, query, None if none else vec_id, -score


_FOUND = "row long, query_id long, vec_id long, score long"


def _cells(keep: int):
    """Arrow function over rows sorted by (g, h, dims, candidates last, longest first): the best rows of each cell."""
    shape = arrow_schema(_FOUND)

    def found(search: Search) -> Iterator[pa.RecordBatch]:
        rows = list(search.rows_of_best())
        for at in range(0, len(rows), 50_000):
            yield batch(shape, *zip(*rows[at : at + 50_000], strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, search = None, [], None
        for b in batches:
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "h", "dims", "asked")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for at, to in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                if at == to:
                    continue
                key, part = tuple(int(k[at]) for k in keys[:3]), b.slice(at, to - at)
                if key != cell:
                    if search:
                        yield from found(search)
                    cell, asked, search = key, [], None
                if keys[3][at]:
                    asked += zip(*(part.column(c).to_pylist() for c in ("row", "id", "norm", "vec")), strict=True)
                    continue
                if search is None:
                    if not asked:
                        continue  # no query of this number of components here
                    rows, ids, norms, vecs = zip(*asked, strict=True)
                    search, asked = Search(list(rows), list(ids), list(norms), _matrix(list(vecs), key[2]), keep), []
                for i in range(0, part.num_rows, BUCKET):
                    s = part.slice(i, BUCKET)
                    ids = np.array(s.column("id").to_pylist(), dtype=object)
                    search.meet(Bucket(s.column("row").to_numpy(), ids, s.column("norm").to_numpy(), _matrix(s.column("vec").to_pylist(), key[2])))
        if search:
            yield from found(search)
        give_back()

    return work


def top_products(vectors: DataFrame, asked: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer products of each asked row with all other rows, ties by smaller id."""
    given = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"), (F.coalesce(asked, F.lit(False)) & F.col(f"`{key}`").isNotNull()).alias("asked"))
    n, n_asked, dims = given.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    deal_q = -(-max(1, n_asked) // max(1, QUERY_BYTES // (8 * max(1, dims))))
    deal_c = max(1, min(64, n // GROUP_ROWS), n * -(-n_asked // deal_q) // CELL_PRODUCTS)

    rows = _integers(given, scale)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asked"), F.lit(deal_c)).otherwise(F.lit(deal_q)) - 1)).alias("other")
    dealt = rows.select("*", other)
    own = F.pmod(F.xxhash64("place"), F.when(F.col("asked"), F.lit(deal_q)).otherwise(F.lit(deal_c))).cast("int")
    dealt = dealt.withColumn("g", F.when(F.col("asked"), F.col("other")).otherwise(own)).withColumn("h", F.when(F.col("asked"), own).otherwise(F.col("other")))
    cells = dealt.select("g", "h", "dims", "asked", "norm", "id", "row", "vec")
    cells = cells.repartitionById(deal_c * deal_q, (F.col("g") * deal_q + F.col("h")).cast("int"))  # a partition for each cell
    found = cells.sortWithinPartitions("g", "h", "dims", F.desc("asked"), F.desc("norm")).mapInArrow(_cells(k), _FOUND)

    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

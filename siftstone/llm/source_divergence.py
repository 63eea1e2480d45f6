"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

1. Each task counts its documents: rows (lang, term, source, document, docs, n), one for each term and source of a portion of documents, the
   first of which stands in the row. So a term that is in every text of a hot source crosses the shuffle a few times a task.
2. One sorted shuffle: repartition by (lang, term), secondary sort by (lang, term, source, document). A scan over the run lengths adds up
   each term's document frequency and its count in each source, and lets a term through with its third document; what it holds of one term
   is at most MIN_DOCS rows.
3. N of each group and V of each language come from what is kept. A share is p = 1 + floor(10^9 (count + 1) / (N + V)).
4. A second sorted shuffle takes (lang, block, block, part of the terms, term, source): sources of a language are numbered and fall into blocks of
   BLOCK, so a scan holds BLOCK x BLOCK sums whatever the number of sources. For each term's run it adds f(p, q) - f(p0, q0) for every pair of the
   two blocks, p0 being the share of a term with count 0, and emits the sums as partial pairs where the run of (lang, block, block, part) ends. Their sum and V * f(p0, q0) is
   the sum over all kept terms, those included that neither source has. A hot language is split by parts of its terms.

Shares and products are exact integers: counts are multiplied as decimals, f stays below 10^18 as p does below 10^9 + 2.

Defined results: a null text, lang or source reads as ''; every row is a document, also where it is repeated or has the id of another; a
group without terms has N = 0; a language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, give_back, stored

MIN_DOCS = 3
TOP_TERMS = 200
#: Rows of counts that a task holds before it passes them on; sources of a block; rows of one part of the terms of a pair of blocks; matrix cells at once.
HELD, BLOCK, PART_ROWS, CELLS = 800_000, 128, 100_000, 1 << 19

#: Bytes of terms: ASCII letters, lower-cased, and all of the characters from U+0080 on; any other ends a term.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = "lang string, term string, source string, document long, docs long, n long"


def term_counts(docs: DataFrame) -> DataFrame:
    """Counts of the terms of each portion of documents, by lang and source."""
    shape = arrow_schema(_COUNTS)
    one = 1 << 40  # documents above, occurrences below: one addition for both

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        parts = []
        for (lang, source), (first, counts) in held.items():
            size = len(counts)
            packed = np.fromiter(counts.values(), dtype=np.int64, count=size)
            term = pa.array(counts.keys(), pa.binary(), size=size).cast(pa.string())
            same = [pa.repeat(pa.scalar(value, kind), size) for value, kind in ((lang, pa.string()), (source, pa.string()), (first, pa.int64()))]
            parts.append(pa.RecordBatch.from_arrays([same[0], term, same[1], same[2], pa.array(packed >> 40), pa.array(packed & one - 1)], schema=shape))
            counts.clear()
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=50_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for b in batches:
            for text, lang, source, document in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("lang", "source", "document")), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_TERMS).split()
                counts = held.setdefault((lang, source), (document, {}))[1]
                before = len(counts)
                for term, n in Counter(words).items():
                    counts[term] = counts.get(term, 0) + one + n
                size += len(counts) - before
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)
        give_back()

    return docs.mapInArrow(work, _COUNTS)


_KEPT = "lang string, term string, source string, n long"


class _TermRun:
    """The run of one term, source by source; rows leave once the term has the documents it needs."""

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.source, self.n, self.total, self.docs = min_docs, None, None, 0, 0, 0
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def source_ends(self) -> None:
        (self.out if self.docs >= self.min_docs else self.waiting).append((*self.key, self.source, self.n))

    def term_ends(self) -> None:
        if self.key:
            self.source_ends()
            if self.docs >= self.min_docs:
                self.out += [*self.waiting, (*self.key, None, self.total)]
        self.key, self.waiting = None, []

    def add(self, key: tuple, source: str, docs: int, n: int) -> None:
        if key != self.key:
            self.term_ends()
            self.key, self.source, self.n, self.total, self.docs = key, source, 0, 0, 0
        elif source != self.source:
            self.source_ends()
            self.source, self.n = source, 0
        self.n, self.total, self.docs = self.n + n, self.total + n, self.docs + docs

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def kept_counts(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, n of the terms in min_docs documents of a language or more; one row of source null holds n of the language."""
    shape = arrow_schema(_KEPT)

    def begins(b: pa.RecordBatch, column: str) -> np.ndarray:
        """Where a row differs from the one before it; the first row does."""
        c = b.column(column)
        return np.concatenate(([True], pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _TermRun(min_docs)
        for b in batches:
            if not b.num_rows:
                continue
            term = begins(b, "lang") | begins(b, "term")
            source = np.flatnonzero(term | begins(b, "source"))  # first rows of the runs of a source within a term
            n, docs = (np.add.reduceat(b.column(c).to_numpy(), source) for c in ("n", "docs"))
            first = np.flatnonzero(term[source])  # first such run of each term
            # the first term may go on from the batch before, the last into the next: these go run by run, all others at once
            ends = [(0, len(source) if len(first) == 1 else first[1])] + [(first[-1], len(source))] * (len(first) > 1)
            whole = slice(first[1], first[-1]) if len(first) > 2 else slice(0, 0)
            out = []
            for k, (at, to) in enumerate(ends):
                part = b.take(pa.array(source[at:to]))
                for *key, where, d, count in zip(*(part.column(c).to_pylist() for c in ("lang", "term", "source")), docs[at:to].tolist(), n[at:to].tolist(), strict=True):
                    run.add(tuple(key), where, d, count)
                out += run.taken()
                if k == 0 and whole.stop > whole.start:
                    at_terms = first[1:-1] - whole.start
                    enough = np.add.reduceat(docs[whole], at_terms) >= min_docs
                    kept = source[whole][np.repeat(enough, np.diff(np.append(at_terms, whole.stop - whole.start)))]
                    heads = b.take(pa.array(source[first[1:-1]][enough]))
                    told = b.take(pa.array(kept))
                    counts = n[whole][np.isin(source[whole], kept, assume_unique=True)]
                    yield batch(shape, told.column("lang"), told.column("term"), told.column("source"), counts)
                    yield batch(shape, heads.column("lang"), heads.column("term"), pa.nulls(heads.num_rows, pa.string()), np.add.reduceat(n[whole], at_terms)[enough])
            if out:
                yield batch(shape, *zip(*out, strict=True))
        run.term_ends()
        if out := run.taken():
            yield batch(shape, *zip(*out, strict=True))

    order = ["lang", "term", "source", "document"]
    return counts.repartition("lang", "term").sortWithinPartitions(*order).select("lang", "term", "source", "docs", "n").mapInArrow(work, _KEPT)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exact for any long."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(F.lit(1_000_000_000)) * wide(count + 1), wide(n + v)) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


_CELLS = "lang string, i int, j int, value long"


def pair_sums(rows: DataFrame) -> DataFrame:
    """lang, i, j (numbers of two sources), value: partial sums of f(p_i, p_j) - f(z_i, z_j) over the terms of a part.

    rows: lang, bi <= bj, part, term, i, p, where the empty term gives the share z of every source of the two blocks.
    """
    shape = arrow_schema(_CELLS)

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p[..., :, None] - q[..., None, :]
        return d * d // q[..., None, :]

    class Run:
        def __init__(self, key: tuple):
            self.lang, self.bi, self.bj, _ = key
            self.zero: dict[int, int] = {}
            self.terms: list[list[tuple[int, int]]] = []
            self.sums = None

        def begin(self) -> None:
            self.number = sorted(self.zero)
            self.at = {i: k for k, i in enumerate(self.number)}
            self.z = np.array([self.zero[i] for i in self.number], dtype=np.int64)
            block = np.array(self.number) // BLOCK
            self.left, self.right = np.flatnonzero(block == self.bi), np.flatnonzero(block == self.bj)
            self.base, self.back = f(self.z[self.left], self.z[self.right]), f(self.z[self.right], self.z[self.left])
            self.sums, self.sums_back = np.zeros_like(self.base), np.zeros_like(self.back)
            self.together = max(1, CELLS // max(1, self.base.size))

        def add(self) -> None:
            if self.sums is None:
                self.begin()
            if self.terms:
                p = np.tile(self.z, (len(self.terms), 1))
                for k, run in enumerate(self.terms):
                    for i, share_ in run:
                        p[k, self.at[i]] = share_
                self.sums += (f(p[:, self.left], p[:, self.right]) - self.base).sum(axis=0)
                if self.bi != self.bj:
                    self.sums_back += (f(p[:, self.right], p[:, self.left]) - self.back).sum(axis=0)
                self.terms = []

        def rows(self) -> Iterator[pa.RecordBatch]:
            self.add()
            number = np.array(self.number, dtype=np.int32)
            sides = [(self.left, self.right, self.sums)] + ([(self.right, self.left, self.sums_back)] if self.bi != self.bj else [])
            for a, c, sums in sides:
                i, j = np.repeat(number[a], len(c)), np.tile(number[c], len(a))
                other = i != j
                yield batch(shape, [self.lang] * int(other.sum()), i[other], j[other], sums.ravel()[other])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, term, run = None, None, None
        for b in batches:
            for *here, word, i, p in zip(*(b.column(c).to_pylist() for c in ("lang", "bi", "bj", "part", "term", "i", "p")), strict=True):
                if here != key:
                    if run:
                        yield from run.rows()
                    key, term, run = here, "", Run(tuple(here))
                if not word:
                    run.zero[i] = p
                    continue
                if word != term:
                    if run.sums is None or len(run.terms) >= run.together:
                        run.add()
                    run.terms.append([])
                    term = word
                run.terms[-1].append((i, p))
        if run:
            yield from run.rows()
        give_back()

    ordered = rows.repartition("lang", "bi", "bj", "part").sortWithinPartitions("lang", "bi", "bj", "part", "term")
    return ordered.mapInArrow(work, _CELLS)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of a language by the sum of f over all kept terms, part
    `term` the terms that a source has more of than its language has."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = docs.select(F.col("text").cast("string").alias("text"), read("lang"), read("source"), F.col("doc_id").cast("long").alias("document"))
    kept = stored(kept_counts(term_counts(given), min_docs), "kept")
    totals, counts = kept.filter("source is null"), kept.filter("source is not null")
    langs = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["source_n", "v", "lang_n"])
    groups = stored(groups.withColumn("i", numbered), "groups", small=True)

    # terms
    told = counts.join(totals.select("lang", "term", F.col("n").alias("all_n")), ["lang", "term"]).join(groups, ["lang", "source"])
    told = told.withColumn("p", share(F.col("n"), F.col("source_n"), F.col("v"))).withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("v"))).filter("p > q")
    terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    # pairs
    blocks = groups.groupBy("lang").agg((F.floor(F.max("i") / BLOCK) + 1).alias("blocks"))
    parts = counts.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", F.floor(F.col("rows") / PART_ROWS + 1).alias("parts"))
    known = groups.join(blocks, "lang").join(parts, "lang")
    number = (F.col("i") / BLOCK).cast("int")
    zero = known.select("lang", "i", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit("").alias("term"), share(F.lit(0), F.col("source_n"), F.col("v")).alias("p"))
    some = counts.join(known, ["lang", "source"]).select("lang", "i", "blocks", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "term", share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"))
    both = zero.union(some).select("lang", "i", "part", "term", "p", number.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    met = both.select("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.col("part").cast("long").alias("part"), "term", "i", "p")
    partial = pair_sums(met).groupBy("lang", "i", "j").agg(F.sum("value").alias("more"))

    left = groups.select("lang", "source", "i", "v", share(F.lit(0), F.col("source_n"), F.greatest(F.col("v"), F.lit(1))).alias("p"))
    right = left.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("p").alias("q"))
    pairs = left.join(right, "lang").filter("i != j").join(partial, ["lang", "i", "j"], "left")
    value = F.col("v") * apart(F.col("p"), F.col("q")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") == 0, 0).otherwise(value).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)

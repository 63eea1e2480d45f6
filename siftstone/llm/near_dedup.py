"""MinHash near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes, and a one-permutation signature: the least hash
   of each of BANDS * ROWS ranges; an empty range takes the value of a full one that a fixed random
   sequence of its own points to. Rows of equal sets fall together at once and go on as one node.
2. Each band of a signature is a bucket. In a bucket a few members are centres, and only edges from them to the others are
   candidates. The first round has two centres, by least id and by a hash. Where members of a bucket are still in different
   components after that, later rounds take new centres in the order of a hash, GROWTH times as many each time, and compare only
   across components. A member that was a centre is done with its bucket, and a bucket leaves when the others are in one component.
   So in the end every pair of a bucket is tested, lies within one component, or is ruled out by its sizes or sketches, which
   never rule out a link. With 24 bands of 4, a pair at a similarity of 0.85
   shares no bucket once in 5 * 10^7, and at 0.8 once in 3 * 10^5.
3. Every candidate is confirmed on the full sets. These are made again for nodes in shared buckets only, which a bitmap of
   fixed size picks out in the scan (it only saves work; false hits change nothing).
4. Components come from repeated contraction of the confirmed edges: in each round of the edges between the components so far.

Every table that a later step reads is written to the shared folder and read back, so no plan holds another and no executor
holds a table; what a round no longer needs is removed. A bucket or centre that holds many members meets its one partner row in
a sort-merge join, which Spark splits where it is skewed.

Defined results: null and empty texts and those without a word have no shingles and are linked with nothing; repeated rows are copies
of each other; two rows with one id and different texts are nodes of their own; a null id is never less than
another; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, bits_of, discard, has_bit, portions, stored

BANDS, ROWS, GROWTH = 24, 4, 4
SKETCH, _SHIFT = 16, 54  # 64 * 16 ranges of the hashes: their first 10 bits
_M = BANDS * ROWS
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_STARTS = np.array([-(-(b << 64) // _M) for b in range(_M)], dtype=np.uint64)
_TRIES = np.random.default_rng(20240229).integers(0, _M, (_M, 128))


class _Words(dict):
    """Hashes of words, of which a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        acc = np.full(n, np.uint64(min(len(h), width)), dtype=np.uint64)
        for i in range(min(width, len(h))):  # a polynomial in a fixed odd number, so that order counts
            acc = acc * _C[0] + _mix(h[i : i + n] * _C[1])
        return np.unique(_mix(acc))


def signature(u: np.ndarray) -> np.ndarray:
    """The least hash of each range; empty ranges densified."""
    at = np.searchsorted(u, _STARTS)
    full = np.append(at[1:], len(u)) > at
    out = u[np.minimum(at, len(u) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_TRIES[empty]]
        source = np.where(hit.any(axis=1), _TRIES[empty, hit.argmax(axis=1)], np.flatnonzero(full)[0])
        out[empty] = out[source]
    return out


def bands(u: np.ndarray) -> np.ndarray:
    s = signature(u).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _C[2]
        for i in range(ROWS):
            acc = acc * _C[0] + _mix(s[:, i])
        return _mix(acc).view(np.int64)


def _node(u: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(u.tobytes())


def signatures(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    schema = ", ".join([f"{c} long" for c in carry] + ["doc_id long, n_shingles long, node binary, bands array<long>"])
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            sizes, nodes, keys = [], [], []
            for text in b.column("text").to_pylist():
                u = shingles(text, width)
                sizes.append(len(u))
                nodes.append(_node(u) if len(u) else None)
                keys.append(bands(u) if len(u) else None)
            yield batch(shape, *[b.column(c) for c in carry], b.column("doc_id"), sizes, nodes, keys)

    return docs.mapInArrow(work, schema)


VERTEX = "struct<rep: bigint, node: binary>"


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles, bits (its sketch): of the given nodes, and of a few others that share their bit."""
    spread = docs.sparkSession.sparkContext.broadcast(bits_of(nodes.select(F.xxhash64("node").alias("bit")), "bit"))
    schema = "node binary, shingles array<long>, bits array<long>"
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, done = spread.value, set()
        for b in portions(batches):
            nodes, sets = [], []
            for text in b.column("text").to_pylist():
                u = shingles(text, width)
                if not len(u) or (node := _node(u)) in done:
                    continue
                if has_bit(have, xxhash.xxh64_intdigest(node, seed=42)):  # Spark's xxhash64 of a binary
                    nodes.append(node)
                    sets.append(u)
                    if len(done) < 200_000:  # copies within a task; the rest falls to the aggregation
                        done.add(node)
            if nodes:
                ends = np.cumsum([0] + [len(u) for u in sets]).astype(np.int32)
                whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield batch(shape, nodes, whole, [sketch(u) for u in sets])

    return docs.mapInArrow(work, schema).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))


def sketch(u: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH ranges whether it has an odd number of hashes: two sketches differ in no more bits than their sets in elements."""
    odd = np.bincount((u >> np.uint64(_SHIFT)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and any other columns) for which 100 * |intersection| >= percent * |union| on the full sets."""
    left = pairs.join(sets.select(F.col("node").alias("__b"), F.col("shingles").alias("__sb")).hint("merge"), F.col("b.node") == F.col("__b"))
    both = left.join(sets.select(F.col("node").alias("__a"), F.col("shingles").alias("__sa")).hint("merge"), F.col("a.node") == F.col("__a"))
    shared = both.withColumn("__n", F.size(F.array_intersect("__sa", "__sb")).cast("long"))
    return shared.filter((100 + percent) * F.col("__n") >= percent * (F.size("__sa") + F.size("__sb"))).select(*pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """vertex, label: the least vertex reachable, for every vertex of an edge (a, b). Vertices of no edge are left out.

    Each turn every vertex goes over to the least of its neighbours and itself, and edges are drawn anew between where their ends
    went. The first turn goes by id, which settles stars; later ones by a new hash each, under which a path, too, halves.
    """
    spark, steps, drawn = edges.sparkSession, [], [edges]
    while not drawn[-1].isEmpty():
        edges, turn = drawn[-1], len(steps)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda v: F.struct((F.lit(0) if turn == 0 else F.xxhash64(f"{v}.node", F.lit(turn))).alias("h"), F.col(v).alias("v"))  # noqa: B023, E731
        least = stored(both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("m")).select("a", F.col("m.v").alias("to")), "least", small=True)
        ends = edges.join(least.select("a", F.col("to").alias("x")), "a").select("x", "b")
        ends = ends.join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        drawn.append(stored(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ends", small=True))
        steps.append(least)
    if not steps:
        return spark.createDataFrame([], f"vertex {VERTEX}, label {VERTEX}")
    went = steps[0].select(F.col("a").alias("vertex"), F.col("to").alias("label"))
    if len(steps) == 1:  # all of a component went to one vertex by id, and its least vertex stayed
        discard(*drawn[1:])
        return went
    for step in steps[1:]:
        went = moved(went, step.select(F.col("a").alias("vertex"), F.col("to").alias("label")))
    went = stored(went, "went", small=True)
    roots = went.groupBy("label").agg(F.min("vertex").alias("least"))
    out = stored(went.join(roots, "label").select("vertex", F.col("least").alias("label")), "labels", small=True)
    discard(went, *steps, *drawn[1:])
    return out


def moved(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with their label replaced by the label of that vertex, where it has one."""
    to = labels.select(F.col("vertex").alias("label"), F.col("label").alias("__to"))
    return rows.join(to, "label", "left").withColumn("label", F.coalesce("__to", "label")).select(*rows.columns)


def _ends() -> list[Column]:
    return [F.least("v", "c.v").alias("a"), F.greatest("v", "c.v").alias("b")]


def _fits(percent: int) -> Column:
    """Sets of these sizes can be linked."""
    return 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")


def stars(now: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from two centres of each bucket, the least id and the least hash, to its members.

    Both orders rank nodes alike in all buckets, so a group that shares many buckets has few centres and a pair comes up once.
    """
    orders = [F.col("v.rep"), F.xxhash64("v.node", F.lit(0))]
    centres = now.groupBy("key").agg(F.array(*[F.min(F.struct(o.alias("o"), "v", "n")) for o in orders]).alias("centres"))
    pairs = now.join(centres, "key").select("v", "n", F.explode("centres").alias("c"))
    return pairs.filter((F.col("v") != F.col("c.v")) & _fits(percent)).select(*_ends()).distinct()


def _place() -> Column:
    """A member's place in its bucket by the hash of its node, about from 0 to the number of members, times 2^31."""
    return F.pmod(F.xxhash64("v.node"), F.lit(1 << 31)) * F.col("members")


def untried(now: DataFrame, tried: int) -> DataFrame:
    """The members that were not among the tried first ones of their bucket, where these are of several labels."""
    rest = now.filter(_place() >= tried << 31)
    live = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    return rest.join(live, "key")


def across(live: DataFrame, centres: int, percent: int) -> DataFrame:
    """Edges (a, b, of labels x, y) from the members at places below centres to those of other labels, where sizes and sketches allow a link.

    Of sets with n + m elements in all, linked ones differ in at most (100 - percent) / (100 + percent) * (n + m).
    """
    marked = live.filter(_place() < centres << 31).select("key", F.struct("v", "n", "label", "bits").alias("c"))
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("c.bits")[i])) for i in range(SKETCH)), F.lit(0))
    close = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("c.n"))
    pairs = live.join(marked, "key").filter((F.col("label") != F.col("c.label")) & _fits(percent) & close)
    return pairs.select(*_ends(), F.least("label", "c.label").alias("x"), F.greatest("label", "c.label").alias("y")).distinct()


def linked_labels(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """vertex, label of the linked nodes among the members (key, v, n, members) of shared buckets; None if no two are linked."""
    pairs = stored(stars(now, percent), "pairs", small=True)
    links = stored(confirm(pairs, sets, percent), "links", small=True)
    labels = components(links)
    now = moved(now.withColumn("label", F.col("v")), labels)
    tried, centres = 0, 2 * GROWTH
    while True:
        live = stored(untried(now, tried), "live", small=True)
        if live.isEmpty():
            return labels
        marked = live.join(sets.select("node", "bits").hint("merge"), F.col("v.node") == F.col("node")).drop("node")
        pairs = stored(across(marked, centres, percent), "pairs", small=True)
        links = stored(confirm(pairs, sets, percent).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links", small=True)
        now = live
        if not links.isEmpty():
            joined = components(links)
            fresh = joined.join(labels.select("vertex"), "vertex", "left_anti")
            labels = stored(moved(labels, joined).union(fresh), "labels", small=True)
            now = moved(live, joined)
        discard(pairs, links)
        tried, centres = centres, centres * GROWTH


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    width: words of a shingle; percent: the least similarity that links; carry: further columns of longs to return. With them
    comes component (binary, null without shingles): two rows are of one group if it is equal, whatever their ids.
    """
    carry = list(carry)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    signed = stored(signatures(docs, width, carry), "signed")
    full = signed.filter("n_shingles > 0")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select(F.explode("bands").alias("key"), F.struct("rep", "node").alias("v"), "n")
    several = buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    now = stored(buckets.join(several.hint("merge"), "key"), "members", small=True)
    known = nodes.select("node", "rep", F.col("node").alias("component"))
    if not now.isEmpty():
        sets = stored(full_sets(docs, now.select("v.node").distinct(), width), "sets")
        labels = linked_labels(now, sets, percent).select(F.col("vertex.node").alias("node"), "label")
        known = known.join(labels, "node", "left").select("node", F.coalesce("label.rep", "rep").alias("rep"), F.coalesce("label.node", "component").alias("component"))
        discard(sets, now)
    linked = full.select("doc_id", "n_shingles", "node", *carry).join(known, "node").select("doc_id", "n_shingles", F.col("rep").alias("component_id"), "component", *carry)
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"), *carry)
    told = linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return told.select("doc_id", "n_shingles", "component_id", "kept", *(["component", *carry] if carry else []))

"""LM scoring by prediction by partial matching: a pretrained byte-context trie with escapes and symbol exclusion.

The model reads a text as its words (A-Z as a-z) with one blank between them, byte by byte, then an end symbol; before
the first byte stand ORDER start symbols. The trie is a set of tables: how often a symbol followed a context of j bytes, j from ORDER to 0,
over all training rows. A symbol is coded in the longest context that was seen; where it was not seen there, the
coder escapes (method D: half the distinct symbols / occurrences; a symbol has its occurrences less a half) to the next
shorter context, in which the symbols of the longer one are excluded; at last all symbols left of 257 are equally likely.

Everything a context sees, its shorter context sees too. So what exclusion takes away at order j depends only on the
context of order j + 1, and one code length belongs to each (context, symbol): the trie is walked once for each
distinct one, by joins of its tables, and a document's score is the sum over its own. The most frequent
(context, symbol) entries (HEAD at most, 12 MB) are broadcast; the rest meet in a shuffle. Nothing is cut from the counts at any size.

The base is a unigram model over words with add-half smoothing. Frequent words, found on a bounded sample, are counted
by each task and looked up; all others meet by word in one shuffle. Words of more than LONG bytes are told apart by a hash of 128
bits, so a long line without a blank that all rows share is a frequent word like any other.

Defined results: a null or empty text, or one without a word, is the end symbol alone; repeated rows are scored alike and counted each;
without training rows N and V are 0 and every symbol is equally likely; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.llm.common import arrow_schema, batch, portions, row_sample, stored

ORDER, HEAD, WORDS, SAMPLE, SLICE, LONG = 5, 1 << 20, 150_000, 20_000, 1 << 20, 64
_SYMBOLS, _END, _START = 257, 256, 0xFF
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: The key of a row, within the tables of score().
ROW = ["uid", "uid2"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def named(words: list[bytes]) -> list[bytes]:
    """The words, long ones by a 128-bit hash behind two bytes that no word has: a table of words is bounded by their number."""
    return words if max(map(len, words), default=0) <= LONG else [w if len(w) <= LONG else b"\xff\xff" + xxhash.xxh3_128_digest(w) for w in words]


def slices(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, starts, documents): a key holds a context and the symbol after it. Long documents come in several slices."""
    parts, docs, ends, size = [], [], [], 0
    pad = bytes([_START]) * ORDER

    def flush():
        data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in parts])
        last = np.cumsum(sizes) - 1
        symbols = data.copy()
        symbols[last[np.array(ends)]] = _END
        context = np.zeros(len(data), dtype=np.int64)
        for j in range(ORDER):
            context[j + 1 :] |= data[: len(data) - j - 1] << (8 * j)
        own = np.ones(len(data), dtype=bool)
        first = last - sizes + 1
        for j in range(ORDER):
            own[first + j] = False
        starts = np.concatenate([[0], np.cumsum(sizes - ORDER)[:-1]])
        return ((context << 9) | symbols)[own], starts, np.array(docs)

    for k, body in enumerate(bodies):
        for at in range(0, len(body) + 1, SLICE):
            final = at + SLICE > len(body)
            before = pad if at == 0 else body[at - ORDER : at]
            parts.append(before + body[at : at + SLICE] + (b"\0" if final else b""))
            docs.append(k)
            ends.append(final)
            size += len(parts[-1])
            if size >= SLICE:
                yield flush()
                parts, docs, ends, size = [], [], [], 0
    if parts:
        yield flush()


def gather(docs: DataFrame) -> DataFrame:
    """g (context and symbol), n (occurrences in all rows), t (in training rows)."""
    schema = "g long, n long, t long"
    shape = arrow_schema(schema)

    def merge(pile: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, n, t = (np.concatenate(x) for x in zip(*pile, strict=True))
        order = np.argsort(g, kind="stable")
        g, n, t = g[order], n[order], t[order]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        return g[at], np.add.reduceat(n, at), np.add.reduceat(t, at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, waiting = [], 0
        for b in portions(batches):
            training = np.array(b.column("training").to_pylist(), dtype=bool)
            bodies = [b" ".join(words_of(t)) for t in b.column("text").to_pylist()]
            for kind in (False, True):
                for keys, _, _ in slices([x for x, y in zip(bodies, training, strict=True) if y == kind]):
                    g, n = np.unique(keys, return_counts=True)
                    pile.append((g, n, n if kind else np.zeros_like(n)))
                    waiting += len(g)
                    if waiting > 2_000_000:
                        pile = [merge(pile)]
                        waiting = len(pile[0][0])
                        if waiting > 1_000_000:
                            yield batch(shape, *pile[0])
                            pile, waiting = [], 0
        if pile:
            yield batch(shape, *merge(pile))

    return docs.select("text", "training").mapInArrow(work, schema).groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _suffix(context: Column, order: int) -> Column:
    return context.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def code_lengths(grams: DataFrame) -> DataFrame:
    """g, n, lp: log10 of the probability that the trained trie gives each (context, symbol) of grams (g, n, t)."""
    split = grams.withColumn("context", F.shiftright("g", 9)).withColumn("symbol", F.col("g").bitwiseAND(F.lit(511)))
    # every order at once: a context of j bytes is the end of one of ORDER bytes
    order = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _suffix(F.col("context"), j).alias("at")) for j in range(ORDER + 1)])).alias("o")
    seen_at = split.filter("t > 0").select(order, "symbol", "t").select("o.j", F.col("o.at").alias("context"), "symbol", "t")
    all_counts = stored(seen_at.groupBy("j", "context", "symbol").agg(F.sum("t").alias("c")), "counts")
    # what the symbols of a context have in the next shorter one
    short = F.coalesce(*[F.when(F.col("j") == j, _suffix(F.col("context"), max(0, j - 1))) for j in range(ORDER + 1)])
    up = all_counts.select((F.col("j") + 1).alias("j"), F.col("context").alias("short"), "symbol", F.col("c").alias("c1"))
    told = all_counts.withColumn("short", short).join(up, ["j", "short", "symbol"], "left")
    all_nodes = stored(told.groupBy("j", "context").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.coalesce(F.sum("c1"), F.lit(0)).alias("x")), "nodes")
    counts = {j: all_counts.filter(F.col("j") == j).drop("j") for j in range(ORDER + 1)}
    nodes = {j: all_nodes.filter(F.col("j") == j).drop("j") for j in range(ORDER + 1)}
    top = nodes[ORDER].select("context", F.col("n").alias("nn"))
    seen = split.filter("t > 0").join(top, "context").select("g", "n", F.log10((F.col("t") - 0.5) / F.col("nn")).alias("lp"))
    state = split.filter("t = 0").select("g", "n", "context", "symbol", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("d0"))
    for j in range(ORDER, -1, -1):
        node = nodes[j].select(F.col("context").alias("at"), F.col("n").alias("nn"), F.col("d").alias("nd"), F.col("x").alias("nx"))
        have = counts[j].select(F.col("context").alias("at"), "symbol", "c")
        if j <= 1:  # at most 257 contexts of at most 257 symbols
            node, have = F.broadcast(node), F.broadcast(have)
        state = state.withColumn("at", _suffix(F.col("context"), j)).join(node, "at", "left").join(have, ["at", "symbol"], "left")
        live = ~F.col("done") & F.col("nn").isNotNull()
        n, d = F.col("nn") - F.col("x0"), F.col("nd") - F.col("d0")
        step = F.when(~live, 0.0).when(F.col("c").isNotNull(), F.log10((F.col("c") - 0.5) / n)).when(d > 0, F.log10(d / (2 * n))).otherwise(0.0)
        state = state.select(
            "g", "n", "context", "symbol", (F.col("lp") + step).alias("lp"), (F.col("done") | (live & F.col("c").isNotNull())).alias("done"),
            F.when(live, F.col("nx")).otherwise(F.col("x0")).alias("x0"), F.when(live, F.col("nd")).otherwise(F.col("d0")).alias("d0"),
        )
    flat = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.greatest(F.lit(1), F.lit(_SYMBOLS) - F.col("d0"))))
    return seen.union(state.select("g", "n", (F.col("lp") + flat).alias("lp")))


class Head:
    """A hash table in numpy: code lengths of the frequent (context, symbol) entries."""

    def __init__(self, g: np.ndarray, lp: np.ndarray):
        self.bits = max(4, int(max(1, len(g)) * 2 - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.float32)
        left, slot = np.arange(len(g)), self.slot(g)
        self.probes = 0
        while len(left):
            at = (slot[left] + self.probes) & (size - 1)
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = g[left[put]], lp[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths, positions of entries that are not here)."""
        at = self.slot(g)
        out = np.where(self.keys[at] == g, self.values[at], np.float32(0))
        left = np.flatnonzero(self.keys[at] != g)
        mask, missing = len(self.keys) - 1, []
        for p in range(1, self.probes + 1):
            if not len(left):
                break
            here = (at[left] + p - 1) & mask
            gone = self.keys[here] == -1
            missing.append(left[gone])
            left = left[~gone]
            if p == self.probes:
                missing.append(left)
                break
            here = (at[left] + p) & mask
            hit = self.keys[here] == g[left]
            out[left[hit]] = self.values[here[hit]]
            left = left[~hit]
        return out, np.concatenate(missing) if missing else left


def top_entries(lengths: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the most frequent classes of counts that fit into head."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = lengths.groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect()  # a few hundred classes
    room, least = head, None
    for r in sizes:
        if (room := room - r["count"]) < 0:
            break
        least = r["k"]
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    got = lengths.filter(level >= least).select("g", "lp").toArrow()
    return got.column("g").to_numpy(), got.column("lp").to_numpy()


def score(docs: DataFrame, training: Column, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs (text and others) with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    docs = docs.select(*keep, F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    docs = docs.withColumn("uid", F.xxhash64(*keep, "text")).withColumn("uid2", F.hash(*keep, "text"))  # 96 bits are a row's key

    lengths = code_lengths(stored(gather(docs), "grams"))
    lengths = stored(lengths.withColumn("lp", F.col("lp").cast("float")), "lengths")  # one precision, at hand or met in the shuffle
    table = spark.sparkContext.broadcast(Head(*top_entries(lengths, HEAD)))

    words = frequent_words(docs)
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    rare = stored(rare_words(docs, index), "words")
    told = rare.filter("i is not null").groupBy("i").agg(F.sum("s").alias("c")).toArrow()  # WORDS at most
    counted = dict(zip(told.column("i").to_pylist(), told.column("c").to_pylist(), strict=True))
    rare = rare.filter("i is null")
    sums = rare.agg(F.sum("first").alias("v")).collect()[0]
    ends = int(counted.get(-1, 0))
    n_all = int(counted.get(-2, 0)) + ends
    v_all = int(sums["v"] or 0) + sum(1 for i, c in counted.items() if i >= 0 and c > 0) + (ends > 0)
    end_value, norm = math.log10(ends + 0.5), math.log10(n_all + 0.5 * (v_all + 1))
    values = spark.sparkContext.broadcast({w: math.log10(counted.get(i, 0) + 0.5) for i, w in enumerate(words)})  # below 0 where c = 0
    index.destroy()
    del words, counted

    out = [f for f in docs.schema.fields if f.name in set(keep)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + ["uid bigint", "uid2 int", "n_tokens bigint", "n_known bigint", "base double", "ppm double", "rest array<struct<g:bigint,f:bigint>>"])
    ended = ends > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, value = table.value, values.value
        for b in portions(batches):
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            tokens, seen, base = [], [], []
            for ws in texts:
                have = np.fromiter(filter(None, map(value.get, named(ws))), dtype=float)
                tokens.append(len(ws) + 1)
                seen.append(int((have > 0).sum()) + ended)
                base.append(have.sum() + end_value)
            ppm, rest = np.zeros(len(texts)), [[] for _ in texts]
            for keys, starts, which in slices([b" ".join(ws) for ws in texts]):
                lp, missing = head.find(keys)
                np.add.at(ppm, which, np.add.reduceat(lp, starts, dtype=float))
                if len(missing):
                    owner = which[np.searchsorted(starts, missing, side="right") - 1]
                    for (k, g), f in Counter(zip(owner.tolist(), keys[missing].tolist(), strict=True)).items():
                        rest[k].append({"g": g, "f": f})
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in out), b.column("uid"), b.column("uid2"), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(ppm), pa.array(rest, pa.list_(pa.struct([("g", pa.int64()), ("f", pa.int64())])))],
                names=[*(f.name for f in out), "uid", "uid2", "n_tokens", "n_known", "base", "ppm", "rest"],
            )

    scored = stored(docs.drop("training").mapInArrow(work, schema), "scored")
    tail = scored.select(*ROW, F.explode("rest").alias("e")).select(*ROW, "e.g", "e.f").join(lengths.select("g", "lp"), "g").groupBy(*ROW).agg(F.sum(F.col("f") * F.col("lp")).alias("tail"))
    rare = rare.select(*ROW, F.col("s").alias("rare"), F.col("k").alias("rare_known"))
    # rows that are equal in every kept column and text have added up in the sums by uid: each gets its share
    copies = F.count("*").over(Window.partitionBy(*ROW))
    both = scored.drop("rest").withColumn("copies", copies).join(rare, ROW, "left").join(tail, ROW, "left")
    share = lambda name: F.coalesce(F.col(name) / F.col("copies"), F.lit(0.0))
    return both.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.round(share("rare_known"))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + share("rare") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("ppm") + share("tail")).alias("score"),
    )


def frequent_words(docs: DataFrame) -> list[bytes]:
    schema = "w binary, n long"
    shape = arrow_schema(schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in portions(batches):
            for t in b.column("text").to_pylist():
                seen.update(named(words_of(t)))
                if len(seen) > 500_000:
                    yield batch(shape, list(seen), list(seen.values()))
                    seen.clear()
        yield batch(shape, list(seen), list(seen.values()))

    top = row_sample(docs, SAMPLE, "uid").select("text").mapInArrow(tally, schema).groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    return top.orderBy(F.desc("n"), "w").limit(WORDS).select("w").toArrow().column(0).to_pylist()


def rare_words(docs: DataFrame, index) -> DataFrame:
    """Sums over a row's rare words: uid, uid2, s (of f * log10(c + 0.5)), k (words with c > 0), first (distinct words met here first);
    and rows (i, s) with the training counts of frequent words, -1: ends, -2: words."""
    schema = "uid long, uid2 int, w binary, f long, training boolean, i int"
    shape = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        have: Counter[int] = Counter()
        for b in portions(batches):
            out: list[tuple] = []
            for uid, uid2, text, training in zip(*(b.column(c).to_pylist() for c in (*ROW, "text", "training")), strict=True):
                counts = Counter(named(words_of(text)))
                if training:
                    have[-1] += 1
                    have[-2] += counts.total()
                for w, f in counts.items():
                    if (i := known.get(w)) is None:
                        out.append((uid, uid2, w, f, training, None))
                    elif training:
                        have[i] += f
                if len(out) > 50_000:
                    yield batch(shape, *zip(*out, strict=True))
                    out = []
            if out:
                yield batch(shape, *zip(*out, strict=True))
        n = len(have)
        yield batch(shape, *[[None] * n] * 3, list(have.values()), [True] * n, list(have))

    deal = F.when(F.col("w").isNotNull(), F.xxhash64("w")).otherwise(F.xxhash64("i", F.spark_partition_id()))
    parts = docs.select(*ROW, "text", "training").mapInArrow(cut, schema).withColumn("deal", deal)
    by_word = Window.partitionBy("deal", "w")
    c = F.sum(F.when(F.col("training"), F.col("f")).otherwise(0)).over(by_word)
    met = parts.withColumn("c", c).withColumn("rank", F.row_number().over(by_word.orderBy(*ROW)))
    rare = F.col("w").isNotNull()
    told = met.select(
        *ROW,
        "i",
        F.when(rare, F.col("f") * F.log10(F.col("c") + 0.5)).otherwise(F.col("f").cast("double")).alias("s"),
        F.when(rare & (F.col("c") > 0), F.col("f")).otherwise(0).cast("long").alias("k"),
        F.when(rare & (F.col("c") > 0) & (F.col("rank") == 1), 1).otherwise(0).cast("long").alias("first"),
    )
    return told.groupBy(*ROW, "i").agg(*[F.sum(x).alias(x) for x in ("s", "k", "first")])

"""Document fingerprints by Order MinHash, in DataFrame expressions only.

A text's tokens are runs of up to 32 characters that are not blank, and single characters of scripts written without blanks. Its
elements are its K-mers of tokens, each with its occurrence number (the first, second, ... of that k-mer). One hash
puts the elements on a ring; permutation i of SLOTS is the ring read from its i-th of SLOTS equal marks on. The L minimal
elements of a permutation, put back into text order, are hashed as a tuple: a slot of the signature. Two texts agree
in a slot if they share the minimal elements and have them in the same order, so likeness falls with edits and
with moves. A fingerprint is the slots in hex, four digits each.

An element is one long: the hash in the high bits, the position in the low ones. One sort of plain longs
brings equal k-mers together in text order, another makes the ring, in which the marks are sorted in as further longs.

Neighbours by id come without a global order: ranges of (id, hash of the text), whose bounds are rows of the table
(every OFTEN-th of a sample by hash, RANGES at most), are each sorted for themselves; the first row of a range also goes
to the range before it, as the neighbour of that one's last row. Many rows of one id, or without one, are parted by their
texts; rows that are equal in both stay together. Texts are shuffled once.

Defined results: a null text is empty; an empty fingerprint belongs to texts without a token, which are alike among themselves (1.0) and to
nothing else (0.0); rows of one id follow each other by their text's hash; null ids come last; a table of one row is
its own neighbour; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, L, SLOTS = 2, 2, 64
RANGE_ROWS, RANGES, OFTEN = 250, 1 << 16, 8
_POS_BITS = 26
_LOW = (1 << _POS_BITS) - 1
_MARK = 64 - (SLOTS - 1).bit_length()
_TOKEN = r"[!-⹿]{1,32}|[^\x00-\x20]"


def _high(x: Column) -> Column:
    return F.shiftright(x, _POS_BITS)


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _put(h: Column, pos: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(pos)


def signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column of SLOTS ints, empty where the text has no token."""
    none = F.array().cast("array<bigint>")
    n0, n1, n2, n3, n4 = (f"__{name}{i}" for i in range(5))
    kept = df.columns
    d = df.withColumn(n0, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))
    tokens = F.col(n0)
    mers = F.slice(tokens, 1, F.greatest(F.lit(1), F.size(tokens) - (K - 1)))
    packed = F.transform(mers, lambda x, i: _put(F.xxhash64(x, *[F.get(tokens, i + j) for j in range(1, K)]), (i + 1).cast("bigint").bitwiseAND(F.lit(_LOW))))
    d = d.select(*kept, F.when(F.size(tokens) > 0, F.sort_array(packed)).otherwise(none).alias(n1))
    p = F.col(n1)
    before = lambda x, i: F.coalesce(_high(x) == _high(F.get(p, i - 1)), F.lit(False))
    d = d.select(*kept, n1, F.filter(p, lambda x, i: ~before(x, i)).alias(n2))
    # later occurrences of a k-mer: their number goes into the hash
    d = d.select(*kept, n2, F.when(F.size(n2) < F.size(n1), F.filter(p, before)).otherwise(none).alias(n3))
    r = F.col(n3)
    starts = F.filter(F.transform(r, lambda x, i: i), lambda i: F.coalesce(_high(F.get(r, i)) != _high(F.get(r, i - 1)), F.lit(True)))
    d = d.select(*kept, n2, n3, F.when(F.size(n3) > 0, starts).otherwise(F.array().cast("array<int>")).alias(n4))
    s = F.col(n4)
    numbered = F.flatten(
        F.transform(s, lambda at, j: F.transform(F.slice(r, at + 1, F.coalesce(F.get(s, j + 1), F.size(r)) - at), lambda x, o: _put(F.xxhash64(_high(x), o), _pos(x))))
    )
    d = d.select(*kept, F.when(F.size(n3) > 0, F.sort_array(F.concat(F.col(n2), numbered))).otherwise(F.col(n2)).alias(n1))
    marks = F.array(*[F.lit((i - SLOTS // 2) << _MARK) for i in range(SLOTS)])
    # a position is never 0, so only marks have all low bits clear
    d = d.select(*kept, n1, F.sort_array(F.concat(F.col(n1), marks)).alias(n2))
    ring = F.col(n2)
    found = F.filter(F.transform(ring, lambda x, i: F.when(x.bitwiseAND(F.lit((1 << _MARK) - 1)) == 0, i)), lambda i: i.isNotNull())
    d = d.select(*kept, n1, found.alias(n3))
    e, size = F.col(n1), F.size(n1)

    def slot(at: Column, i: Column) -> Column:
        mine = [F.get(e, (at - i + j) % size) for j in range(L)]
        ordered = F.sort_array(F.array(*[F.struct(_pos(x).alias("p"), _high(x).alias("h")) for x in mine])) if L > 2 else None
        if ordered is not None:
            tuple_hash = F.xxhash64(F.transform(ordered, lambda y: y["h"]))
        else:
            a, b = mine
            tuple_hash = F.when(_pos(a) <= _pos(b), F.xxhash64(_high(a), _high(b))).otherwise(F.xxhash64(_high(b), _high(a)))
        return tuple_hash.bitwiseAND(F.lit(0xFFFF)).cast("int")

    return d.select(*kept, F.when(size > 0, F.transform(F.col(n3), slot)).otherwise(F.array().cast("array<int>")).alias(name))


def as_text(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False)))) / F.lit(float(SLOTS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(same)


def _key() -> list[Column]:
    """The order of the rows: descending doc_id with nulls last, then the text's hash, as three columns that rise."""
    return [F.col("doc_id").isNull().cast("bigint").alias("k0"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("k1"), F.col("__tie").alias("k2")]


def bounds_of(docs: DataFrame) -> list[tuple[int, int, int]]:
    """Keys of rows that part the order into ranges of about RANGE_ROWS rows, RANGES at most; the first is the least key of all.

    They are every OFTEN-th key of a sample by a hash of the key, so rows of one id, or without one, are parted by their texts.
    """
    rows = docs.count()
    ranges = max(1, min(RANGES, rows // RANGE_ROWS))
    share = int((1 << 30) * min(1.0, ranges * OFTEN / max(1, rows))) if ranges > 1 else 0
    key, place = F.struct(*_key()), F.pmod(F.xxhash64(*_key()), F.lit(1 << 30))
    found = docs.agg(F.min(key).alias("least"), F.collect_set(F.when(place < share, key)).alias("some")).collect()[0]  # about RANGES * OFTEN at most
    return sorted({tuple(x) for x in (found["least"], *sorted(found["some"])[OFTEN - 1 :: OFTEN]) if x is not None})


def _literal(values: list[int]) -> Column:
    """An array as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_neighbours(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs in ranges (columns __range, __ghost), the window in which the row below is the next one, and ghosts at the ends.

    A range runs from one bound up to the next. The row at a bound is the first of its range and also goes to the range before, as
    the neighbour of that one's last row; the first of all goes to the last range. A row finds its range by halving.
    """
    bounds = bounds_of(docs)
    d = docs.select("*", *_key())
    arrays = [_literal([b[i] for b in bounds]) for i in range(3)]

    def at(i: Column) -> list[tuple[Column, Column]]:
        return [(F.get(a, i), F.col(f"k{j}")) for j, a in enumerate(arrays)]

    def not_above(i: Column) -> Column:
        (x0, y0), (x1, y1), (x2, y2) = at(i)
        return (x0 < y0) | ((x0 == y0) & ((x1 < y1) | ((x1 == y1) & (x2 <= y2))))

    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)]) if bounds else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(bounds)) & F.coalesce(not_above(lo + step - 1), F.lit(False)), lo + step).otherwise(lo))
    d = d.withColumn("__range", found - 1)
    first = F.coalesce(F.reduce(F.array(*[x == y for x, y in at(F.col("__range"))]), F.lit(True), lambda a, b: a & b), F.lit(False)) if bounds else F.lit(False)
    before = F.when(first, F.pmod(F.col("__range") - 1, F.lit(max(1, len(bounds)))))
    places = F.array_compact(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("g")), F.when(before.isNotNull(), F.struct(before.alias("r"), F.lit(True).alias("g")))))
    d = d.withColumn("__place", F.explode(places)).select(*docs.columns, "k0", "k1", "k2", F.col("__place.r").alias("__range"), F.col("__place.g").alias("__ghost"))
    return d, Window.partitionBy("__range").orderBy("__ghost", "k0", "k1", "k2")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("__tie", F.xxhash64("text"))
    d, w = with_neighbours(docs)
    d = d.withColumn("__next", F.coalesce(F.lead("text").over(w), F.lit("")))
    d = d.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("__cut", F.floor(F.col("n_chars") / 3).cast("int"))
    d = d.withColumn("__edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("__cut")).cast("int")), F.substring("__next", F.lit(1), F.col("__cut"))))
    d = d.withColumn("edited_sha256", F.sha2("__edited", 256))
    d = signature(d, "text", "__a").drop("text", "__next")
    d = signature(d, "__edited", "__e").drop("__edited")
    d = d.withColumn("__n", F.lead("__a").over(w)).filter(~F.col("__ghost"))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("__a")).alias("fingerprint"),
        as_text(F.col("__e")).alias("edited_fingerprint"),
        likeness(F.col("__a"), F.col("__e")).alias("near_edited"),
        likeness(F.col("__a"), F.col("__n")).alias("near_next"),
    )

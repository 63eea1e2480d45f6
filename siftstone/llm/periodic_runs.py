"""Periodic runs: stretches of words that repeat at least `exponent` times in a row, found within each document.

A run is a stretch of consecutive words with smallest period q and length >= max(min_length, exponent * q) that no neighbouring
word extends keeping period q.

1. Repeated k-gram masking. A run and itself moved on by q overlap in length - q words, at least k = min over q of
   max(min_length, exponent * q) - q of them (minimum_overlap). So every word of a run stands in a k-gram that occurs twice in
   the document. Words outside such k-grams cannot join a run: what is left falls into segments, and every run lies in one. k-grams are told
   apart by a 64-bit hash; two unlike ones of one hash only leave a longer segment.
2. Main-Lorentz on each segment. A segment is halved; the repetitions across its middle come from longest common extensions to both sides of
   it for every period (prefix tables, linear time); then each half by itself. Words are compared by their number in the document, so runs are exact.
   A half that lies inside a run of period q can only hold further runs of periods below q / (exponent - 1), so long plain
   runs are not searched again and again.

The work needs no shuffle: a document is searched in the task that reads it, in O(n log n) of its surviving words. Memory is some 100 bytes a
word of the longest text of a task; texts are taken one by one.

Defined results: a null or empty text, and one without words, has no words, no run and an empty collapsed text; a document of fewer than
min_length words has no run; equal rows get equal results, each its own row; an empty table gives no row. Any columns can be carried
along, whatever their names, as the text alone is read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import crc_column, give_back

#: A word of the contracts, for SQL.
WORD = r"[^\x20\x09-\x0D]+"
MIN_LENGTH = 6
EXPONENT = 4


def minimum_overlap(min_length: int, exponent: int) -> int:
    """The fewest words that a run shares with itself moved on by its period: k of the k-grams."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def segments(words: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The stretches [from, to) of words that stand in k-grams which occur twice."""
    n = len(words) - k + 1
    if n < 2:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(k):
        grams *= np.uint64(0x100000001B3)
        grams += mixed[j : j + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    inside = np.concatenate(([False], np.cumsum(steps)[:-1] > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _own_prefixes(p: list[int], m: int) -> list[int]:
    """z[i], i <= m: the longest common prefix of p and p[i:]."""
    n = len(p)
    z, left, right = [n] + [0] * m, 0, 0
    for i in range(1, min(m, n - 1) + 1):
        if i < right and z[i - left] < right - i:
            z[i] = z[i - left]
            continue
        at = max(right, i)
        while at < n and p[at] == p[at - i]:
            at += 1
        z[i], left, right = at - i, i, at
    return z


def _prefixes_in(t: list[int], p: list[int], z: list[int], m: int) -> list[int]:
    """The longest common prefix of p and t[i:], i < m; z as _own_prefixes gives it for m or more."""
    n, size, out, left, right = len(t), len(p), [], 0, 0
    for i in range(m):
        if i < right and z[i - left] < right - i:
            out.append(z[i - left])
            continue
        at = max(right, i)
        while at < n and at - i < size and t[at] == p[at - i]:
            at += 1
        out.append(at - i)
        left, right = i, at
    return out


def runs_of(words: list[int], min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a segment, by halving around the middle."""
    n, found = len(words), {}
    todo = [(0, n, n // exponent)]
    while todo:
        lo, hi, most = todo.pop()
        here: dict[tuple[int, int], int] = {}
        most = min(most, (hi - lo) // exponent)
        if hi - lo < min_length or most < 1:
            continue
        mid = (lo + hi) // 2
        before, after = words[lo:mid][::-1], words[mid:hi]
        reach = min(most, len(before), len(after))
        forward, backward = _own_prefixes(after, most), _own_prefixes(before, most)
        # against the middle: what precedes mid + q (from the far end on), and what follows mid - q
        to_left = _prefixes_in(words[lo : mid + reach][::-1], before, backward, reach)
        to_right = _prefixes_in(words[mid - reach : hi], after, forward, reach)
        for q in range(1, reach + 1):
            need = max(min_length, exponent * q)
            for start, end in (
                (mid - to_left[reach - q], mid + q + (forward[q] if q < len(after) else 0)),
                (mid - q - (backward[q] if q < len(before) else 0), mid + to_right[reach - q]),
            ):
                if end - start < need or start >= mid or end <= mid:
                    continue
                if start and words[start - 1] == words[start - 1 + q] or end < n and words[end] == words[end - q]:
                    continue  # it goes on beyond this half: seen whole around another middle
                here[start, end] = min(q, here.get((start, end), q))
        for a, b in ((lo, mid), (mid, hi)):
            limits = [(q - 1) // (exponent - 1) for (s, e), q in here.items() if s <= a and b <= e]
            todo.append((a, b, min([most, *limits])))
        found |= here
    return sorted((s, e - s, q) for (s, e), q in found.items())


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    if len(words) < min_length:
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(ids):
        return []
    parts = segments(np.array(ids, dtype=np.int64), minimum_overlap(min_length, exponent))
    out = [(a + s, size, q) for a, b in parts if b - a >= min_length for s, size, q in runs_of(ids[a:b], min_length, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, size, q in runs:
        keep[start + q : start + size] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc (the columns in carry as one struct, all of docs where it isn't given), n_words, runs (start, length, period; by start, then
    period) and the collapsed text."""
    held = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    given = docs.select(F.struct(*held).alias("doc"), F.col(f"`{text}`").cast("string").alias("words"))
    doc = given.schema["doc"].dataType.simpleString()
    schema = f"doc {doc}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, texts = [], [], []
            for value in b.column("words"):
                words = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                found = find_runs(words, min_length, exponent)
                sizes.append(len(words))
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in found])
                texts.append(b" ".join(collapse(words, found)))
            columns = [b.column("doc"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "runs", "collapsed"])
        give_back()

    return given.mapInArrow(work, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as q)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.withColumn("best", best).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.length) div -best.q").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, to: str = "planted") -> DataFrame:
    """docs with one more column: the text, with a periodic stretch planted by its id.

    With h = crc32(decimal id) and g = floor(h / 10), where h % 10 = 0 and the text has n > 0 words: each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). All other texts are as they were.
    """
    h = crc_column()
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    drawn = docs.withColumn("__w", words).withColumn("__g", F.floor(h / 10))
    drawn = drawn.withColumn("__a", F.when(F.size("__w") > 0, F.expr("cast(__g % size(__w) as int)")))
    drawn = drawn.withColumn("__p", F.expr("cast(1 + (size(__w) - __a) div (3 + __g % 8) as int)"))
    turned = F.expr("array_join(transform(__w, (x, i) -> if(i < __a, x, __w[__a + (i - __a) % __p])), ' ')")
    return drawn.withColumn(to, F.when(F.col("__a").isNotNull(), turned).otherwise(F.col("text"))).drop("__w", "__g", "__a", "__p")

"""Periodic runs against their definition, word by word."""

import hashlib
import random
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import periodic_runs as P
from siftstone.llm.queries import QUERIES


def by_definition(words, min_length=6, exponent=4):
    """Every maximal stretch of every period, its smallest period kept."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (*best[:2], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(0, 59), st.integers(1, 15), st.integers(1, 8), st.integers(1, 5))
def test_runs_are_those_of_the_definition(letters, at, period, min_length, exponent):
    words = [c.encode() for c in letters]
    turned = [w if i < at else words[at + (i - at) % period] for i, w in enumerate(words)] if at + period <= len(words) else words
    exponent = max(2, exponent)
    assert P.find_runs(turned, min_length, exponent) == by_definition(turned, min_length, exponent)


def test_k_follows_from_the_minimum_overlap():
    assert P.minimum_overlap(6, 4) == 5
    assert P.minimum_overlap(3, 2) == 2
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)).encode() for _ in range(500)]
    assert P.find_runs(words) == []
    words[100:112] = [b"x", b"y", b"z"] * 4
    words[300:305] = words[20:25]  # a repeated 5-gram alone makes no run
    assert P.find_runs(words) == [(100, 12, 3)]


def test_runs_within_runs_and_side_by_side():
    inner = [b"a"] * 6 + [b"b"]
    words = inner * 5 + [b"c"] + [b"d", b"e"] * 4
    assert P.find_runs(words) == by_definition(words)
    assert (0, 35, 7) in P.find_runs(words) and (0, 6, 1) in P.find_runs(words) and (36, 8, 2) in P.find_runs(words)


def test_query_follows_the_contract_on_whole_tables(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = QUERIES["op11_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(contract(*d) for d in docs)
    assert sum(r[1] > 0 for r in rows) > 10


def test_defined_results(spark):
    ten = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "x " * 6), (5, "x " * 6), (None, "y\x0bz\x0c" * 9), (ten, "u v w " * 7), (ten, ""), (ten, None), (6, "é è " * 5 + "long " * 20_000)]
    docs = spark.createDataFrame([(i, t, "c", 7) for i, t in texts], "doc_id long, text string, runs string, n_words long")
    out = P.periodic_runs(P.planted(docs), "planted")
    assert {"doc", "n_words", "runs", "collapsed"} == set(out.columns)
    first = {(r.doc.doc_id, r.doc.text): r for r in out.collect()}
    assert first[1, None].n_words == 0 and first[1, None].runs == [] and first[1, None].collapsed == "" and first[1, None].doc.runs == "c"
    assert [tuple(r) for r in first[5, "x " * 6].runs] == [(0, 6, 1)] and first[5, "x " * 6].collapsed == "x"
    assert sorted(map(repr, (tuple(r) for r in P.digests(out).collect()))) == sorted(repr(contract(i, t)) for i, t in texts)
    assert P.digests(P.periodic_runs(docs.limit(0))).count() == 0

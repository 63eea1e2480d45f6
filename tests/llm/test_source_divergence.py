"""Source divergence against its definition over all terms and pairs."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from siftstone.llm import source_divergence as D
from siftstone.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs):
    """docs: (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        groups[lang].add(source)
        df[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        v = len(kept)

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, 200)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return sorted(out)


def got(spark, docs):
    df = spark.createDataFrame([(i, *d, "x") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string")
    out = D.divergence(df)
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select text, lang, source from '{sf}/documents.parquet'").fetchall()


@pytest.mark.parametrize("small", [False, True])
def test_whole_tables(spark, docs, monkeypatch, small):
    if small:  # blocks of 3 sources, parts of 200 rows, portions of 500 terms
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        for name, value in (("BLOCK", 3), ("PART_ROWS", 200), ("HELD", 500), ("CELLS", 40)):
            monkeypatch.setattr(D, name, value)
    try:
        assert got(spark, docs) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_is_that_of_the_sql(spark, sf, docs):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = sorted(con.sql(f"select lang, source, part, item, value, rank from ({ORACLES['op13_source_divergence']})").fetchall())
    told = QUERIES["op13_source_divergence"](spark, sf).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in told.collect()) == rows == brute(docs)


def test_defined_results(spark):
    few = [(None, None, None), ("", "en", "a"), ("Aa bB aa", "en", "a"), ("aa É é", "en", "b"), ("aa É ", "en", "c"), ("x É_É\x00É", "en", None), ("y" * 100_000 + " AA", "en", "b")]
    few += [("one two", "de", "s"), ("one", "de", "t"), ("two", "de", "u"), ("1 2 3", "fr", "s"), ("ab ab", "es", "s"), ("ab ab", "es", "s"), ("ab ab", "es", "s")]
    assert got(spark, few) == brute(few)
    assert got(spark, []) == []
    assert ("de", "s", "pair", "t", 0, 1) in got(spark, few)


def test_shares_beyond_a_long(spark):
    one = spark.range(1).selectExpr("4000000000000000000L as c", "5000000000000000000L as n", "7L as v")
    assert one.select(D.share(one.c, one.n, one.v).alias("p")).first().p == 1 + 10**9 * (4 * 10**18 + 1) // (5 * 10**18 + 7)

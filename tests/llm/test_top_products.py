"""Exact top-k products against all products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import top_products as T
from siftstone.llm.queries import ORACLES, QUERIES


def brute(rows, k, scale=256, asked=lambda i: i is not None and i % 50 == 0):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for a, (i, q) in enumerate(whole):
        if asked(i):
            scores = [(-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(whole) if a != b and len(c) == len(q)]
            out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(map(repr, out))


def got(spark, rows, k, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(parts)
    out = T.top_products(df, F.col("vec_id") % 50 == 0, k)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(repr, (tuple(r) for r in out.collect())))


@pytest.fixture
def small_parts(monkeypatch):
    """Buckets of 16 rows, 7 queries at once, groups of 60 rows, cells of 20 queries."""
    for name, value in (("BUCKET", 16), ("TOGETHER", 7), ("GROUP_ROWS", 60)):
        monkeypatch.setattr(T, name, value)


def test_search_over_many_buckets_of_unlike_lengths(small_parts):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    vectors = np.concatenate([rng.normal(size=(200, 8)) * rng.lognormal(0, 1.5, size=(200, 1)), np.repeat(base, 10, axis=0) + 0.02 * rng.normal(size=(300, 8)), np.zeros((5, 8))])
    m = np.floor(256 * vectors).astype(np.int64)
    norms = np.sqrt((m.astype(float) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids = np.array(range(len(m)), dtype=object)
    pruned = {"closed": 0, "coordinates": 0}
    within = T.Bucket.within

    def counted(self, unit, c):
        rows = within(self, unit, c)
        pruned["coordinates"] += len(rows) < len(self.ids)
        return rows

    T.Bucket.within = counted
    try:
        search = T.Search(list(range(len(m))), list(range(len(m))), norms.tolist(), m, 5)
        for at in range(0, len(m), T.BUCKET):
            o = order[at : at + T.BUCKET]
            pruned["closed"] += int((search.least > search.norms * norms[o[0]] * (1 + T.SLACK)).sum())
            search.meet(T.Bucket(o, ids[o], norms[o], m[o]))
    finally:
        T.Bucket.within = within
    assert pruned["closed"] > 1000 and pruned["coordinates"] > 100
    all_scores = m @ m.T
    for q, best in enumerate(search.best):
        assert best == sorted((-int(s), False, j) for j, s in enumerate(all_scores[q]) if j != q)[:5]


def test_every_query_meets_every_row(spark, small_parts, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BYTES", 20 * 8 * 6)  # cells of 20 queries at most
    rng = np.random.default_rng(5)
    rows = [(i * 10, (rng.normal(size=6) * rng.choice([0.1, 1, 40])).tolist()) for i in range(400)]
    assert got(spark, rows, 5) == brute(rows, 5)
    ties = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [(i, [1.0, 0.5, -0.5]) for i in range(300, 420)]
    assert got(spark, ties, 4) == brute(ties, 4)


def test_defined_results(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, [1.0, None]), (100, None), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0])]
    rows += [(None, [9.0, 9.0]), (None, [9.0, 9.0]), (7, [9.0, 9.0]), (250, [1.0]), (300, []), (350, []), (400, [0.0, 0.0]), (1, [-0.001, 0.0]), (450, [1.0, 2.0, 3.0])]
    assert got(spark, rows, 5) == brute(rows, 5)
    assert got(spark, rows, 50) == brute(rows, 50)
    big = [(0, [1e6, 1e6]), (1, [1e6, -1e6 + 2**-8]), (2, [3.0, 4.0]), (50, [1e9, 1e-2]), (3, [1e6 + 2**-8, 1e6])]
    assert got(spark, big[:3] + big[4:], 3) == brute(big[:3] + big[4:], 3)
    assert got(spark, [(50, [1e12, 3.0]), (1, [2**-8, 1e3]), (2, [2**-7, 7.0])], 2) == brute([(50, [1e12, 3.0]), (1, [2**-8, 1e3]), (2, [2**-7, 7.0])], 2)
    assert got(spark, [], 5) == []
    assert got(spark, [(3, [1.0])], 5) == []


def test_query_is_that_of_the_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    told = QUERIES["op12_top_products"](spark, sf)
    assert dict(told.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    rows = {tuple(r) for r in told.select("query_id", "rank", "vec_id", "score").collect()}
    assert rows == set(con.sql(f"select query_id, rank, vec_id, score from ({ORACLES['op12_top_products']})").fetchall()) and rows

"""Faults that a reviewer found in rounds of review, each by the least case that shows it."""

from pyspark.sql import functions as F


def test_signs_that_cancel_leave_a_vector():
    import itertools
    import zlib

    import numpy as np

    from siftstone.operators.models import HashingEmbedder

    hashes = {f"w{i}": zlib.crc32(f"w{i}".encode()) for i in range(200)}
    a, b = next((a, b) for a, b in itertools.combinations(hashes, 2) if hashes[a] % 64 == hashes[b] % 64 and hashes[a] >> 31 != hashes[b] >> 31)
    vectors = HashingEmbedder(64).embed([f"{a} {b}", a, ""])
    assert np.allclose(np.linalg.norm(vectors, axis=1), [1, 1, 0])


def test_average_link_by_sums_equals_means_of_pairs():
    import numpy as np

    from siftstone.operators.selection import average_link

    def plain(m, target, largest=4):
        product, groups = m @ m.T, [[i] for i in range(len(m))]
        while len(groups) > target:
            best = None
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    if len(groups[i]) + len(groups[j]) <= largest:
                        value = float(product[np.ix_(groups[i], groups[j])].mean())
                        if best is None or value > best[0] + 1e-12:
                            best = value, i, j
            if best is None:
                break
            groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))
        return groups

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 17, 40):
        v = rng.choice([-1.0, 0.0, 1.0], (n, 6)) + 0.5  # few values: many ties
        assert average_link(v.tolist(), 4) == plain(v / np.linalg.norm(v, axis=1, keepdims=True) if n else v, 4)
    many = rng.normal(size=(300, 64))
    assert sorted(i for g in average_link(many.tolist(), 6) for i in g) == list(range(300))


def test_whole_words_are_ascii_words(spark):
    from siftstone.operators import evidence as ev

    rows = spark.createDataFrame([("año no",), ("baño",), ("ñno cough",), ("Cough",), ("coughs",), ("NO fever",)], "t string")
    got = [(r.o, r.p) for r in rows.select(ev.observations(F.col("t")).alias("o"), ev.polarity(F.col("t")).alias("p")).collect()]
    assert got == [([], "negative"), ([], "positive"), (["cough"], "negative"), (["cough"], "positive"), ([], "positive"), (["fever"], "negative")]


def test_cut_references_stay_as_they_are_written():
    from siftstone.sources import html

    page = "<title>a &amp</title><article><h1>a &amp</h1><p>b &amp; c &#233;&copy; &copy &lt &amp;lt; &nosuch;</p></article>"
    assert html.read_sections(page)[1:] == [("a &amp", "b & c é© &copy &lt &lt; &nosuch;")]
    assert html.read_article(page) == ("a &amp", "b & c é© &copy &lt &lt; &nosuch;")
    assert html.read_sections(None) == []


def test_titles_without_plain_letters_are_none(spark, tmp_path):
    from siftstone.plans.registry import QUERIES

    spark.createDataFrame([(1, "<title>Éç Ç</title><h1>x</h1>"), (2, "<title>é B</title>"), (3, "<p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: (r.headed, r.titled) for r in QUERIES["u2_sql_pages"](spark, str(tmp_path)).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}


def most_rows_of_a_join(df):
    """Rows of the join of a plan that made most of them."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *map(walk, children)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_lookup_makes_no_pairs_of_copies(spark):
    from siftstone.operators import catalog

    row = F.struct((F.col("id") % 3).alias("m"), F.col("id"))
    names = F.element_at(F.array(F.lit("hot bolt"), F.lit("hot ring"), F.lit("old ring")), (row["m"] + 1).cast("int"))
    e = spark.range(900).select(F.col("id").alias("entry_id"), names.alias("topic"), F.lit("k").alias("kind"), F.lpad((F.col("id") * 7 % 900).cast("string"), 3, "0").alias("file"), F.lit("u").alias("url"))
    e = e.select("*", F.array(F.split("topic", " ")).alias("phrases"), F.split("topic", " ").alias("terms"))
    q = spark.range(600).select(F.col("id").alias("query_id"), names.alias("query")).withColumn("words", F.split("query", " "))
    found = catalog.lookup(e, q, ["the"], 5)
    assert most_rows_of_a_join(found) <= 5 * 600  # each query with each entry of a like name: 360,000
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.entry_id, r.match))
    first = {m: [(i, "exact") for i in sorted((i for i in range(900) if i % 3 == m), key=lambda i: i * 7 % 900)[:5]] for m in range(3)}
    assert got == {i: first[i % 3] for i in range(600)}
    assert catalog.lookup(e, q.limit(1), ["the"], None).count() == 300  # without a depth, all entries of its name


def test_similar_pairs_are_few_before_whole_sets_meet(spark):
    import itertools
    import random

    from siftstone.operators import documents as dc

    rng, rows = random.Random(5), []
    for i in range(120):  # sets of 40 of 60 words: all meet in a word, few are alike
        w = rng.sample(range(60), 40)
        rows += [(2 * i, "s", w), (2 * i + 1, "s" if i % 2 else "t", w[:-2] + [100 + i])]
    data = [(k, g, [f"w{x}" for x in w]) for k, g, w in rows]
    found = dc.similar_pairs(spark.createDataFrame(data, "k long, g string, words array<string>"), "k", "g", "words", 80)
    sets = {k: (g, set(w)) for k, g, w in data}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) >= 60
    assert most_rows_of_a_join(found) <= 240 * 40  # the words of all sets; pairs that meet in a word alone are more


def test_large_sets_that_meet_and_are_not_alike_go_no_further(spark, monkeypatch):
    import itertools
    import random

    from siftstone.operators import documents as dc

    rng, data = random.Random(7), []
    for i in range(60):  # sets that share a fourth of their words, and two like ones of each
        w = rng.sample(range(6000), rng.choice([380, 1500, 1600, 3000]))
        data += [(3 * i, "s", w), (3 * i + 1, "s", w[9:] + [6000 + i]), (3 * i + 2, "s", w[:-7])]
    data += [(500, "s", data[0][2][::-1]), (501, "t", data[0][2]), (0, "s", data[4][2][5:]), (502, "s", []), (503, None, data[0][2]), (504, "s", None), (None, "s", [1, 2])]  # a key of two sets
    rows = spark.createDataFrame([(k, g, None if w is None else [f"w{x}" for x in w]) for k, g, w in data], "k long, g string, words array<string>")
    want, sets = {}, {}
    for k, g, w in data:
        if k is not None and g and w:
            sets.setdefault((g, frozenset(w)), []).append(k)
    for (ga, a), (gb, b) in itertools.permutations(sets, 2):
        if ga == gb and min(sets[ga, a]) < min(sets[gb, b]) and len(a & b) >= 0.8 * len(a | b):
            want[min(sets[ga, a]), min(sets[gb, b]), round(len(a & b) / len(a | b), 9)] = len(sets[ga, a]), len(sets[gb, b])
    for pairs, piece in ((1 << 18, 256), (50, 7)):
        monkeypatch.setattr(dc, "PAIRS", pairs, raising=False)
        monkeypatch.setattr(dc, "PIECE", piece, raising=False)
        found = dc.similar_pairs(rows, "k", "g", "words", 80)
        assert sorted((r.a, r.b, r.jaccard, r.copies_a, r.copies_b) for r in found.collect()) == sorted((*p, *n) for p, n in want.items()) and len(want) > 180
        assert most_rows_of_a_join(found) <= 400 and most_rows_of_a_shuffle(found) <= 400  # all pairs are 16,653


def test_python_text_functions_over_pieces_of_a_batch(spark):
    from siftstone.functions import text as tx

    rows = spark.range(1000).coalesce(1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("Ä ﬁ "), F.col("id").cast("string"))).alias("t"))
    got = {r.id: (r.n, r.w) for r in rows.select("id", tx.clean_nfkc(F.col("t")).alias("n"), tx.catalog_tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: (f"Ä fi {i}", ["a", "fi", str(i)]) if i % 7 else (None, None) for i in range(1000)}
    assert rows.filter("id < 0").select(tx.catalog_tokens(F.col("t"))).collect() == []


def most_rows_of_a_shuffle(df):
    """Rows of the exchange of a plan that wrote most of them."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return max([own, *map(walk, children)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_whole_rankings_shuffle_no_pairs(spark, monkeypatch):
    import numpy as np

    from siftstone.operators import ranking as rk

    monkeypatch.setattr(rk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (300, 8)).astype("f4")  # few values: many ties
    for kind, much in (("float", 1.0), ("double", 1.0), ("double", 100.0)):  # 100: scores beyond 32 bits
        v = spark.createDataFrame([((i * 7) % 300, [float(x) * much for x in m[i]]) for i in range(300)], f"vec_id long, embedding array<{kind}>").repartition(3)
        q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        found = rk.knn(v, q, None, "l2")
        assert most_rows_of_a_shuffle(found) <= 60 * 300 / 20  # pairs: 18,000
        at = {(i * 7) % 300: m[i].astype("f8") * much for i in range(300)}
        want = {}
        for x in range(0, 300, 5):
            order = sorted((float(np.round(((at[y] - at[x]) ** 2).sum(), 9)), y) for y in range(300))
            want.update({(x, y): (s, r) for r, (s, y) in enumerate(order, 1)})
        assert {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in found.collect()} == want
    assert rk.knn(v, q.filter("query_id < 0"), None, "l2").collect() == []
    half = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0**-5, 0.0])], "vec_id long, embedding array<float>")  # 0.0009765625
    assert [r.score for r in rk.knn(half, half.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), None, "l2").collect()] == [0.0, 0.000976563]


def test_whole_rankings_shuffle_no_vectors_for_a_group(spark, monkeypatch):
    from siftstone.operators import ranking as rk

    monkeypatch.setattr(rk, "BLOCK", 8)
    monkeypatch.setattr(rk, "GROUP", 2)
    v = spark.range(0, 400, 1, 3).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0), (F.col("id") % 10).cast("double")).alias("embedding"))
    q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = rk.knn(v, q, None, "l2")
    assert most_rows_of_a_shuffle(found) <= 80  # the queries; blocks for each group are 51 * 40
    got = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in found.collect()}
    for x in range(0, 400, 5):
        order = sorted((float((y % 10 - x % 10) ** 2), y) for y in range(400))
        assert all(got.pop((x, y)) == (s, r) for r, (s, y) in enumerate(order, 1))
    assert not got


def test_rankings_read_in_several_places_are_made_once(spark, sf):
    from siftstone.plans.registry import QUERIES

    for name in ("a6_role_queries", "a4_hybrid_pool", "w19_rank_faults", "x36_topic_hits", "p16_concept_gate", "p17_concept_notes"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "[a-z]{3,}" not in plan, name  # the tokens of a ranking


def test_texts_of_candidates_are_read_once(spark, sf):
    from siftstone.plans.registry import QUERIES

    for name in ("p16_concept_gate", "p17_concept_notes"):
        found = QUERIES[name](spark, sf).inputFiles()
        assert found and not any("documents" in f for f in found), name  # what hits name lies in the shared folder


def test_words_of_texts_are_never_broadcast(spark, tmp_path):
    from siftstone.operators import planning as pl

    spark.range(200).select(F.col("id").alias("k"), F.lit("amber birch cedar " * 50).alias("text")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))  # equal texts: one entry of a dictionary
    asked = spark.createDataFrame([("a", "amber cedar"), ("b", "birch dune")], "concept string, alternative string")
    found = pl.concept_matches(texts, "k", asked)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [k" in plan and "BroadcastHashJoin [k" not in plan and "BuildLeft" not in plan  # texts met both ways by broadcasts before
    assert found.groupBy("concept").count().collect() == [("a", 200)]


def test_rows_without_a_vector_are_not_found(spark):
    from siftstone.operators import ranking as rk

    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = v.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for k in (5, None):
        assert [r.vec_id for r in rk.knn(v, q, k, partial=True).orderBy("rank").collect()] == [0, 2]


def test_pairs_are_counted_where_postings_are(spark, monkeypatch):
    from siftstone.operators import ranking as rk

    monkeypatch.setattr(rk, "PAIRS", 1000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("amber birch cedar").alias("text"))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.lit("cedar amber dune birch").alias("query"))
    found = rk.overlaps(docs, asked, 3)
    assert most_rows_of_a_shuffle(found) <= 4 * 300  # postings; pairs: 60,000
    assert found.rdd.getNumPartitions() == 60
    assert found.groupBy("overlap", "size").count().collect() == [(3, 3, 60000)]
    ranked = rk.bm25(docs, asked, depth=2)
    assert most_rows_of_a_shuffle(ranked) <= 60 * 200 * 2  # two of each query from each of 60 parts
    assert {(r.doc_id, r["rank"]) for r in ranked.collect()} == {(0, 1), (1, 2)}


def test_a_row_for_each_text_is_shuffled(spark, monkeypatch):
    from siftstone.operators import ranking as rk

    texts = F.when(F.col("id") % 10 != 9, F.concat_ws(" ", F.array_repeat(F.lit("ambers birch"), 5), F.lit("dune elm fir"))).otherwise(F.when(F.col("id") % 20 == 9, ""))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), texts.alias("text"))
    asked = spark.createDataFrame([(1, "cedar amber"), (2, "birch elm the amber"), (3, "of"), (4, None)], "query_id long, query string")
    got = []
    for listed, small in ((4096, rk.SMALL), (2, rk.SMALL), (2, 1)):  # terms in the plan, broadcast, by a shuffle
        monkeypatch.setattr(rk, "LISTED", listed, raising=False)
        monkeypatch.setattr(rk, "SMALL", small)
        terms = rk.query_terms(asked, "query_id", "query")
        met = rk.postings(docs, "doc_id", "text", terms, rk._few(asked, "query"), True, 40)
        if small > 1:
            assert most_rows_of_a_shuffle(met) <= 300  # 270 texts have 12 tokens each
        found = rk.overlaps(docs, asked, 1), rk.bm25(docs, asked, depth=5)
        got.append([sorted(map(tuple, x.collect())) for x in (met, *found)])
    assert got[0] == got[1] == got[2]
    assert len(got[0][0]) == 270 * 4 + 15 and len(got[0][1]) == 540 and len(got[0][2]) == 10


def test_both_channels_share_one_shuffle_of_postings(spark, sf):
    from siftstone.plans.registry import QUERIES

    df = QUERIES["a4_rrf"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning(doc_id") - plan.split("Initial Plan")[0].count("ReusedExchange") <= 1


def test_a_task_gets_pairs_of_bounded_bytes(spark, monkeypatch):
    from siftstone.operators import ranking as rk

    monkeypatch.setattr(rk, "BLOCK", 8)
    monkeypatch.setattr(rk, "BATCH", 4096)
    v = spark.range(0, 1600, 1, 2).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))  # 768 bytes
    pairs = rk._meet(v, q, "vec_id", "embedding", "query_id", "query")
    rows = pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert rows[0] == 200 * 4 and rows[1] <= 4 * 8  # all in two tasks before

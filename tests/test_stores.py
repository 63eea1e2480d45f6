"""Articles, collections, frozen evidence, audits of wholes, and what fails closed."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.operators import audit, constraints, documents, evidence, ranking, services
from siftstone.operators.models import HashingEmbedder
from siftstone.session import exists, workspace
from siftstone.sources import html, readers, sinks

PAGE = """<html><head><title>T</title><meta property="og:title" content="From  meta"><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav>
<main><h1>Head &amp; title</h1><p>First <b>bold</b>, text.</p><h2>Part</h2><ul><li>one</li><li>two <i>x</i></li></ul><ol start="3"><li>three</li><li value="7">seven</li><li>eight</li></ol>
<table><tr><th>a</th><td>b</td></tr></table><script>var x</script><aside>side</aside><h1>Head & title</h1></main><footer>foot</footer></body></html>"""


def test_article():
    title, body = html.read_article(PAGE)
    assert title == "Head & title"
    assert body == "First bold, text.\n\nPart\n====\n\n- one\n\n- two x\n\n3. three\n\n7. seven\n\n8. eight\n\na | b |"
    assert html.read_article("<body><p>no article</p></body>") is None and html.read_article(None) is None and html.read_article("") is None
    assert html.read_article("<title>t</title><article></article><main><p>x</p></main>") == ("t", "x")
    assert html.read_article('<meta property="og:title" content="m"><div id="content">said</div>') == ("m", "said")
    assert html.read_article('<h1>a</h1><article>short</article><article>the longer one</article>') == ("a", "the longer one")
    assert html.read_article("<h1>a</h1><ol reversed><li>x</li><li>y</li></ol><article><ol reversed><li>x</li><li>y</li></ol></article>")[1] == "2. x\n\n1. y"
    assert html.read_article("<article>without a title</article>") is None


def test_article_column(spark):
    got = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "k int, html string").select("k", html.article(F.col("html")).alias("a")).collect()
    assert {r.k: r.a and r.a.title for r in got} == {1: "Head & title", 2: None, 3: None}


def test_collection(spark):
    c = services.Collection(spark, workspace(spark) + "/c")
    rows = spark.createDataFrame([(i, f"text of {i} " * (i + 1), "train" if i % 4 else "test") for i in range(20)], "k long, text string, split string")
    assert not c.exists() and c.count() == 0 and not c.reset()
    assert c.build(rows.filter("k < 10"), HashingEmbedder(16), "k", "text").first().asDict() == {"before": 0, "after": 7, "added": 7, "truncated": 0}
    told = c.build(rows, HashingEmbedder(16), "k", "text", most_words=30).first()  # what is there stays as it is
    assert (told.before, told.after, told.added, told.truncated) == (7, 15, 8, 8)
    batches = list(c.scroll("k", 4))
    assert [len(b) for b in batches] == [4, 4, 4, 3] and [r.k for b in batches for r in b] == [i for i in range(20) if i % 4] and len(batches[0][0].embedding) == 16
    with pytest.raises(ValueError, match="stored under"):
        c.build(rows, HashingEmbedder(8), "k", "text")
    with pytest.raises(Exception, match="an empty text"):
        c.build(spark.createDataFrame([(99, " ", "train")], "k long, text string, split string"), HashingEmbedder(16), "k", "text")
    assert c.count() == 15 and c.reset() and not c.exists()


def test_evidence_is_retrieved_once(spark):
    at, calls = workspace(spark) + "/e", []

    def search(n):
        calls.append(n)
        return spark.createDataFrame([("q", f"d{i}", i, f"s{i}") for i in range(n)], "query_id string, source_id string, rank int, text_sha string")

    first = services.EvidenceService(spark, at, lambda: search(3)).snapshots().collect()
    assert services.EvidenceService(spark, at, lambda: search(9)).snapshots().collect() == first and calls == [3] and first[0].n_rows == 3


def test_an_index_without_faults_passes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (100 + i)) for i in range(4)], "doc_id long, text string")
    expected = documents.chunks(docs)
    stored = expected.withColumn("url", F.lit("u"))
    vectors = expected.select("chunk_id", F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    told = audit.index_audit(stored, audit.index_faults(stored, expected, vectors, 2)).first()
    assert told.passed and told.chunks == expected.count() and all(told[k] == 0 for k in audit.INDEX_FAULTS)
    worse = stored.filter("doc_id > 0").withColumn("text", F.when(F.col("doc_id") == 2, "other").otherwise(F.col("text")))
    faults = audit.index_faults(worse, expected, vectors.withColumn("embedding", F.when(F.col("chunk_id") != stored.filter("doc_id = 3").first().chunk_id, F.col("embedding"))), 2)
    found = {(r.fault) for r in faults.collect()}
    assert found == {"not_stored", "wrong_id", "differs_from_source", "missing_vector"} and not audit.index_audit(worse, faults).first().passed


def test_replay_tells_nulls_from_values(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, None), (3, 2.0), (5, 1.0)], "k int, v double")
    assert {(r.k, r.field, r.fault) for r in audit.replay(a, b, ["k"], ["v"]).collect()} == {(3, "v", "value"), (4, "row", "not_reproduced"), (5, "row", "not_stored")}


def test_envelopes_that_are_no_json(spark):
    rows = spark.createDataFrame([(1, "no json"), (2, None), (3, '{"status":"completed","output":[]}'), (4, '{"status":"completed","output":[{"type":"message","role":"assistant","status":"completed","content":[{"type":"output_text","text":"a"},{"type":"output_text","text":"b"}]}]}')], "k int, e string")
    text, failure = audit.envelope_text(F.col("e"))
    got = {r.k: (r.t, r.f) for r in rows.select("k", text.alias("t"), failure.alias("f")).collect()}
    assert got == {1: (None, "provider_failure"), 2: (None, "provider_failure"), 3: (None, "provider_failure"), 4: ("ab", None)}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        base = [f"w{rng.randrange(4)}{k}" for k in range(rng.randrange(1, 40))]
        rows.append((i, "ab"[i % 2], sorted(set(base)) if i % 5 else []))
        if i % 3 == 0:
            rows.append((1000 + i, "ab"[i % 2], sorted(set(base[:-2] + ["new"]))))
        if i % 7 == 0:
            rows.append((2000 + i, "ab"[i % 2], sorted(set(base))))
    got = documents.similar_pairs(spark.createDataFrame(rows, "k long, g string, w array<string>"), "k", "g", "w", 80).collect()
    sets = {}
    for k, g, w in rows:
        key = (g, frozenset(w))
        sets[key] = (min(k, sets[key][0]) if key in sets else k, sets[key][1] + 1 if key in sets else 1)
    want = set()
    for (g, x), (a, n) in sets.items():
        for (h, y), (b, m) in sets.items():
            if g == h and a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                want.add((a, b, n, m))
    assert {(r.a, r.b, r.copies_a, r.copies_b) for r in got} == want and len(want) > 10 and len(got) == len(want)


@pytest.mark.parametrize("small", [1 << 25, 0])
def test_knn_by_blocks(spark, monkeypatch, small):
    """Broadcast or not, and over blocks of three vectors, the search is that of all pairs."""
    monkeypatch.setattr(ranking, "SMALL", small)
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rng = random.Random(2)
    v = [(i, [rng.randrange(-2, 3) + 0.5 for _ in range(4)]) for i in range(40)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    q = d.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for measure in ("cosine", "l2"):
        for k in (5, None):
            got = {(r.query_id, r.rank): r.vec_id for r in ranking.knn(d, q, k, measure).collect()}
            for i, x in v:
                if i % 7 == 0:
                    norm = sum(a * a for a in x) ** 0.5
                    score = {j: round(-sum(a * b / norm for a, b in zip(x, y)) if measure == "cosine" else sum((a - b) ** 2 for a, b in zip(x, y)), 9) for j, y in v}
                    order = sorted(score, key=lambda j: (score[j], j))[:k]
                    assert [got[i, n + 1] for n in range(len(order))] == order


def test_bm25_reads_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "asthma wheezing"), (2, "kidney kidney"), (3, "asthma"), (4, ""), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "asthma asthma"), ("b", "asthma"), ("c", "nothing here"), ("d", "")], "query_id string, query string")
    got = ranking.bm25(docs, asked).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in got} == {("a", 3, 1), ("a", 1, 2), ("b", 3, 1), ("b", 1, 2)}
    assert ranking.overlaps(docs, asked, 1).count() == 4


def test_places_and_estimates(monkeypatch, tmp_path):
    monkeypatch.delenv("SIFTSTONE_X", raising=False)
    project, other = tmp_path / "p", tmp_path / "w"
    project.mkdir()
    assert readers.location("~/x", "SIFTSTONE_X", str(project), str(other), "m.json").endswith("/x")
    assert readers.location(None, "SIFTSTONE_X", str(project), str(other), "m.json") == str(other)
    (project / "m.json").write_text("{}")
    assert readers.location(None, "SIFTSTONE_X", str(project), str(other), "m.json") == str(project)
    monkeypatch.setenv("SIFTSTONE_X", str(tmp_path))
    assert readers.location(None, "SIFTSTONE_X", str(project), str(other), "m.json") == str(tmp_path)
    config = {"hidden_size": 768, "num_hidden_layers": 12, "intermediate_size": 3072, "num_attention_heads": 12, "max_position_embeddings": 512, "vocab_size": 30522}
    told = services.model_memory(config, 438_000_000)
    assert told["parameters"] == 109_483_009 and told["peak_gb"] == pytest.approx(2 * 0.438 + 1.25)
    with pytest.raises(ValueError, match="base size"):
        services.model_memory({**config, "hidden_size": 1024}, 438_000_000)
    with pytest.raises(ValueError, match="sound size"):
        services.model_memory(config, 0)


def test_attached_parts_are_checked(spark):
    d = spark.createDataFrame([(1, "x")], "k int, p string")
    doc = F.struct(F.col("k").alias("a"), F.lit(None).cast("string").alias("plan"))
    assert d.select(services.attached(doc, "plan", F.col("p"), F.length("p") > 0).alias("d")).first().d.asDict() == {"a": 1, "plan": "x"}
    with pytest.raises(Exception, match="invalid plan"):
        d.select(services.attached(doc, "plan", F.col("p"), F.length("p") > 3).alias("d")).collect()


def test_quotes_and_time(spark):
    import datetime

    src = spark.createDataFrame([(1, "abc def ghi abc")], "k int, text string")
    q = spark.createDataFrame([(1, "abc d"), (1, "def g"), (1, "zzz"), (1, ""), (2, "abc")], "k int, quote string")
    assert [(r.start, r.end, r.text) for r in evidence.quoted_spans(q, src, "k").collect()] == [(0, 9, "abc def g")]
    assert {(r.k, r.quote) for r in evidence.missing_quotes(q, src, "k").collect()} == {(1, "zzz"), (2, "abc")}
    told = datetime.datetime.fromisoformat(spark.range(1).select(ids.now_iso().alias("t")).first().t)
    assert abs((datetime.datetime.now(datetime.timezone.utc) - told).total_seconds()) < 120


def test_first_mismatch_stops(spark):
    claims = spark.createDataFrame([(1, "Patient denies cough", ["f1"]), (2, "Cough is present", ["f1"])], "k int, text string, refs array<string>")
    facts = spark.createDataFrame([("f1", "cough", "recorded")], "ref string, concept string, polarity string")
    found = evidence.consistency(claims, facts, "k").filter("status = 'mismatch'")
    assert [r.k for r in found.collect()] == [1]
    with pytest.raises(constraints.Violation, match="consistency"):
        constraints.assert_valid(found, "consistency")
    constraints.assert_valid(found.filter("k = 2"), "consistency")


def test_half_a_pair_is_removed(spark):
    at = workspace(spark)
    d = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no labels"):
        sinks.write_apart(d, d.select("k", F.raise_error(F.lit("no labels")).cast("string").alias("label")), at, ["label"])
    assert not exists(spark, f"{at}/features")
    sinks.write_apart(d, d.select("k", F.col("v").alias("label")), at, ["label"])
    assert spark.read.parquet(f"{at}/labels").count() == 1
    with pytest.raises(ValueError, match="already there"):
        sinks.write_apart(d, d.select("k", F.col("v").alias("label")), at, ["label"])
    assert spark.read.parquet(f"{at}/features").count() == 1

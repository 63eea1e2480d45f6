"""Judged pools, reviewed selections, verified proposals, reranker inputs and unit windows: golden values, guards and edges."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import documents, evaluation, hits
from siftstone.operators import judging as ju
from siftstone.operators import packing
from siftstone.operators.constraints import Violation
from siftstone.sources import sinks


def pool(spark, *rows):
    return spark.createDataFrame([*rows], "pool_id int, candidate_id int, relevance string")


def test_review_status(spark):
    rows = [(1, 1, "relevant"), (1, 2, "not_relevant"), (2, 1, "relevant"), (2, 2, None), (3, 1, None), (4, 1, "uncertain"), (5, 1, "partially_relevant")]
    got = {r.pool_id: (r.reviewed, r.complete, r.status) for r in ju.review_status(pool(spark, *rows)).collect()}
    assert got == {1: (2, True, "complete"), 2: (1, False, "provisional"), 3: (0, False, "withheld"), 4: (1, False, "provisional"), 5: (1, True, "complete")}
    assert ju.review_status(pool(spark)).count() == 0


def test_pool_metrics_know_their_depth(spark):
    """Sixty candidates: a deep system of fifty, and one that gives five whatever is asked."""
    label = {0: "relevant", 9: "relevant", 49: "relevant", 55: "relevant", 19: "partially_relevant", 3: "uncertain"}
    c = pool(spark, *[(1, i, label.get(i, "not_relevant")) for i in range(61)], (2, 1, None), (3, 1, "not_relevant"))
    lists = {"deep": [*range(50)], "short": [19, 0, 40, 49, 9], "silent": []}
    ranks = spark.createDataFrame([(1, i, s, r) for s, v in lists.items() for r, i in enumerate(v, 1)] + [(2, 1, "deep", 1), (3, 1, "deep", 1)], "pool_id int, candidate_id int, system string, rank int")
    systems = spark.createDataFrame([(p, s, d) for p in (1, 2, 3) for s, d in (("deep", 50), ("short", 5), ("silent", 50))], "pool_id int, system string, depth int")
    got = {(r.pool_id, r.mode, r.system, r.k): r for r in ju.pool_metrics(c, ranks, systems).collect()}
    line = lambda *k: [got[(*k, d)].recall for d in (5, 10, 20, 50)]
    assert line(1, "strict", "deep") == [0.25, 0.5, 0.5, 0.75] and line(1, "strict", "short") == [0.75] * 4 and line(1, "inclusive", "deep") == [0.2, 0.4, 0.6, 0.8]
    assert [got[1, "strict", "short", k].cutoff for k in (5, 10, 20, 50)] == [5] * 4 and got[1, "strict", "short", 5].mrr == 0.5 and got[1, "inclusive", "short", 5].mrr == 1.0
    assert line(1, "strict", "silent") == [0.0] * 4 and got[1, "strict", "silent", 5].mrr == 0.0
    assert not any(k[0] == 2 for k in got)  # nobody judged it
    assert got[3, "strict", "deep", 5].positives == 0 and got[3, "strict", "deep", 5].recall is None and got[3, "strict", "deep", 5].mrr is None


def test_depth_topics(spark):
    ranked = spark.createDataFrame([(1, r, f"{'Flu' if r % 4 == 0 else 'Pain'} {r}", r % 2 == 0) for r in range(1, 13)], "q int, rank int, title string, ok boolean")
    got = {r.depth: r for r in ju.depth_topics(ranked, ["q"], "title", ["FLU", "none"], F.col("ok"), (5, 10)).collect()}
    assert (got[5].returned, got[5].retained, got[5].topic_ranks) == (5, 2, {"FLU": [4], "none": []}) and got[10].topic_ranks["FLU"] == [4, 8]


ANALYSIS = "pool_id int, candidate_id int, role string, eligible boolean, score double, query string, sha string, selected boolean, counterfactual boolean, rule string, counterfactual_rule string"
REVIEW = "pool_id int, candidate_id int, role string, kind string, score double, query string, sha string, transition string"


def test_reviews_are_held_against_what_they_judged(spark):
    a = spark.createDataFrame([(1, i, "symptoms", i != 4, 0.5, "q", "s", i == 1, i < 3, "cap", "weak") for i in range(1, 6)], ANALYSIS)
    good = [(1, i, "symptoms", "A", 0.5, "q", "s", ju.NEWLY) for i in (1, 2, 3)]
    review = lambda *rows: spark.createDataFrame([*rows], REVIEW)
    assert ju.review_faults(a, review(*good)).count() == 0
    counts = {r.kind: r for r in ju.kind_counts(ju.reviewed_pairs(a, review(*good))).collect()}
    assert (counts["A"].pairs, counts["A"].selected, counts["A"].not_selected, counts["A"].counterfactual, counts["A"].newly) == (3, 1, 2, 2, 1)
    assert counts["A"].rejections == {"selection": {"cap": 2}, "counterfactual": {"weak": 1}} and counts["B"].pairs == counts["C"].newly == 0 and len(counts) == 3
    bad = [
        (1, 9, "symptoms", "A", 0.5, "q", "s", ju.NEWLY), (1, 1, "history", "A", 0.5, "q", "s", ju.NEWLY), (1, 1, "symptoms", "D", 0.5, "q", "s", ju.NEWLY), (1, 4, "symptoms", "A", 0.5, "q", "s", ju.NEWLY),
        (1, 2, "symptoms", None, None, "Q", None, ju.NEWLY), (1, 3, "symptoms", "Z", 9.0, "x", "y", "other"),
    ]
    found = sorted((r.candidate_id, r.rule) for r in ju.review_faults(a, review(*bad)).collect())
    assert found == [(1, "kind"), (1, "unknown_pair"), (2, "kind"), (2, "query"), (2, "score"), (2, "sha"), (4, "not_eligible"), (9, "unknown_pair")]
    with pytest.raises(Exception, match="constraint broken"):
        ju.reviewed_pairs(a, review(*good, bad[0])).collect()


def test_verified_selection(spark):
    """One case for each end, and that the order of reviews decides."""
    text = lambda body: f"Topic: x\nTitle: t\nURL: u\nType: y\n{body}"
    catalog = spark.createDataFrame([(i, text(f"body {i}\nmore")) for i in range(1, 6)], "document_id int, text string")
    ids = {1: [1, 2, 3], 2: None, 3: [1, 1], 4: [9], 5: [1, 2, 3, 4], 6: [1, 2], 7: [1, 2], 8: [], 9: [1], 10: [2, 1], 11: [1]}
    yes, no = ("relevant", ["a = b"], ["body"]), ("not_relevant", None, [])
    told = {
        1: {1: yes, 2: no, 3: ("relevant", ["liter"], ["more"])}, 3: {1: yes}, 4: {9: yes}, 5: {i: yes for i in range(1, 5)}, 6: {1: yes, 2: (None, None, None)}, 7: {1: yes, 2: ("relevant", ["a"], [])}, 9: {1: no},
        10: {2: (None, None, None), 1: ("relevant", ["zzz"], [])}, 11: {1: ("relevant", [], ["Title: t"])},
    }
    p = spark.createDataFrame([*ids.items()], "case_id int, ids array<int>")
    r = spark.createDataFrame([(c, d, *v) for c, m in told.items() for d, v in m.items()], "case_id int, document_id int, verdict string, fact_quotes array<string>, content_quotes array<string>")
    f = spark.createDataFrame([(c, ["a = b"], ["a literal"]) for c in ids], "case_id int, rendered array<string>, literals array<string>")
    got = {x.case_id: (x.status, x.selected, x.reviewed) for x in ju.verified_selection(p, r, catalog, f).collect()}
    assert got == {
        1: ("selected_and_verified", [1, 3], 3), 2: ("selector_failure", [], 0), 3: ("invalid_selection", [], 0), 4: ("invalid_selection", [], 0), 5: ("invalid_selection", [], 0), 6: ("content_review_failure", [], 2),
        7: ("selected_and_verified", [1, 2], 2), 8: ("no_selection", [], 0), 9: ("no_selection", [], 1), 10: ("content_review_failure", [], 1), 11: ("content_contract_failure", [], 1),
    }


def test_reranker_inputs(spark):
    schema = "query_id int, role string, text string, facts array<struct<kind:string,text:string>>, age int, population string"
    q = lambda *rows: spark.createDataFrame([*rows], schema)
    facts = lambda role, *x: [(role, v) for v in x]
    good = [(1, "symptoms", "pain; fever", facts("symptoms", "pain", "fever", "chills"), 40, "adult"), (2, "history", "asthma", facts("history", "asthma"), 70, "older adult"), (3, "history", "x", facts("history", "x"), None, "")]
    got = {(r.query_id, r.variant): r.text for r in ju.reranker_inputs(q(*good)).collect()}
    assert got[1, "original"] == "pain; fever" and got[1, "prefix_only"] == "Current findings: pain; fever" and got[2, "prefix_only"] == "Historical/background: asthma"
    assert got[1, "role_explicit"] == "The patient's current reported findings are pain, fever and chills. What medical information is relevant to these current findings?"
    assert got[2, "role_explicit"] == "The reported historical or background information for an older adult is asthma. What medical information is relevant to this history?"
    assert got[3, "role_explicit"].startswith("The reported historical or background information is x.")
    bad = [(4, "symptoms", "t", [], 3, "child"), (5, "symptoms", "t", facts("history", "a"), 3, "child"), (6, "history", "t", facts("history", *"abcde"), 64, "older adult"), (7, "other", "", None, None, None)]
    assert sorted((r.query_id, r.rule) for r in ju.input_faults(q(*good, *bad)).collect()) == [(4, "facts"), (5, "kind"), (6, "facts"), (6, "population"), *((7, x) for x in ("facts", "kind", "population", "role", "text"))]
    with pytest.raises(Exception, match="constraint broken"):
        ju.reranker_inputs(q(*bad)).collect()


def test_unit_windows(spark):
    """No unit is cut, lines part units, the header is paid for, and a document with a unit over the budget has no window."""
    rows = [(1, "One two. Three four! no cut. 5 six", "h"), (2, "- item a\n\n- item b\r\nlast", "h h"), (3, "short\n" + "w " * 20, "h"), (4, None, "h"), (5, " \n ", None), (6, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, header string")
    words = lambda x: len(x.split())
    got = sorted((r.doc_id, -1 if r.window is None else r.window, r.text, r.tokens) for r in packing.unit_windows(docs, "doc_id", "text", "header", words, 7).collect())
    assert got == [(1, 0, "One two.\nThree four! no cut.", 7), (1, 1, "5 six", 3), (2, 0, "- item a", 5), (2, 1, "- item b\nlast", 6), (3, -1, ("w " * 20).strip(), 21), (6, 0, "a b\nc", 3)]
    assert packing.units("A. B? c. D") == ["A.", "B? c.", "D"] and packing.unit_windows(docs.limit(0), "doc_id", "text", "header", words).count() == 0
    long = spark.createDataFrame([(1, "Word word word. " * 50_000, "h")], "doc_id int, text string, header string")
    cut = packing.unit_windows(long, "doc_id", "text", "header", words, 100).agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("w")).first()
    assert cut.w == 150_000 and cut.n == -(-50_000 // 33)


def test_strict_json(spark):
    """Nothing is converted, 1.0 is no whole number: a fault for each field that is missing, too many or of another kind."""
    rows = {1: '{"a": 1, "b": [], "c": null}', 2: '{"a": "1", "b": {}, "c": "x"}', 3: '{"a": 1.0, "b": [1], "c": true, "d": 0, "e": 0}', 4: "{}", 5: "[1]", 6: "{", 7: None, 8: "null", 9: '{"a": 10000000000, "b": [{"x": 1}], "c": "", "a/b": 1}'}
    df = spark.createDataFrame([*rows.items()], "k int, j string")
    got = sorted((r.k, r.path, r.fault) for r in hits.strict_faults(df, "k", "j", {"a": "integer", "b": "array", "c": "string|null"}).collect())
    assert got == [
        (2, "/a", "kind"), (2, "/b", "kind"), (3, "/a", "kind"), (3, "/c", "kind"), (3, "/d", "unexpected"), (3, "/e", "unexpected"), (4, "/a", "missing"), (4, "/b", "missing"), (4, "/c", "missing"), (5, "/", "not_an_object"),
        (6, "/", "not_json"), (7, "/", "not_json"), (8, "/", "not_an_object"), (9, "/a/b", "unexpected"),
    ]


def hit(**changed):
    text = "Body ä"
    sha = hashlib.sha256(text.encode()).hexdigest()
    m = {"topic_id": "12", "parent_id": "lib:topic:12", "chunk": 0, "title": "T", "url": "https://h.org/a", "chunk_sha256": sha, "content_sha256": sha, "tokens": 256, "spans": [{"start": 0, "end": 3, "split": False}]}
    r = {"distance": 1, "max_distance": 1.1, "metric": "squared_l2", "acceptance": "distance_gate", "snapshot": "0" * 24}
    out = {"chunk_id": "lib:topic:12:chunk:0", "document_id": "lib:topic:12", "source": "lib", "title": "T", "url": "https://h.org/a", "text": text, "metadata": m, "retrieval": r}
    for path, value in changed.items():
        *outer, last = path.split("__")
        at = out
        for step in outer:
            at = at[step]
        at[last] = value
    return json.dumps(out)


def test_hits(spark):
    cases = {
        "good": (hit(), set()), "lookup": (hit(retrieval__distance=9.5, retrieval__acceptance="exact_source_lookup"), set()), "gate": (hit(retrieval__distance=1.2), {"gate"}), "refused": (hit(retrieval__acceptance="rejected"), {"gate"}),
        "sha": (hit(text="other"), {"checksum"}), "hex": (hit(metadata__content_sha256="ABC"), {"checksum"}), "blank": (hit(text=" "), {"checksum"}), "title": (hit(title="t"), {"binding"}), "tokens": (hit(metadata__tokens=0), {"tokens"}),
        "user": (hit(url="https://a:b@h.org/a", metadata__url="https://a:b@h.org/a"), {"url"}), "host": (hit(url="https://g.org/a", metadata__url="https://g.org/a"), {"url"}), "spans": (hit(metadata__spans=[]), {"spans"}),
        "empty_span": (hit(metadata__spans=[{"start": 3, "end": 3, "split": False}]), {"spans"}), "span_kind": (hit(metadata__spans=[{"start": 0, "end": 3, "split": 0}]), {"spans"}), "parent": (hit(metadata__parent_id="lib:topic:1"), {"identity"}),
        "metric": (hit(retrieval__metric="cosine"), {"retrieval"}), "extra": (hit(more=1), {"envelope"}), "below": (hit(retrieval__distance=-1), {"distance"}), "kind": (hit(metadata__tokens="9"), {"metadata", "tokens"}),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("none", None), ("text", "{")], "k string, j string")
    got = {}
    for r in hits.hit_faults(df, "k", "j", "lib", "h.org").collect():
        got.setdefault(r.k, set()).add(r.rule)
    assert {k: got.get(k, set()) - ({"checksum"} if k == "kind" else set()) for k in cases} == {k: v[1] for k, v in cases.items()}
    assert got["none"] == got["text"] == set(hits.hit_rules("lib", "h.org"))
    assert hits.valid_hits(df.filter("k in ('good', 'lookup')"), "k", "j", "lib", "h.org").select("hit.metadata.chunk").collect() == [(0,), (0,)]
    with pytest.raises(Exception, match="constraint broken"):
        hits.valid_hits(df, "k", "j", "lib", "h.org").collect()


def test_topic_hits(spark):
    rows = [(1, "Flu", "Overview", "x", "p", "l"), (1, "Cold", "", "x", "p", None), (2, "Cold", "WHAT ARE flu?", "x", "p", "l"), (3, "Cold", "What is cold?", "x", "p", "l"), (4, "Flu", None, "", "p", "l")]
    h = spark.createDataFrame(rows, "query_id int, title string, section string, text string, provenance string, licence string")
    e = spark.createDataFrame([(i, ["Flu", "Fever"]) for i in range(1, 6)], "query_id int, titles array<string>")
    got = {r.query_id: tuple(r)[1:] for r in hits.topic_hits(h, e).collect()}
    assert got == {1: (2, False, True, False, False), 2: (1, True, False, True, True), 3: (1, True, False, False, False), 4: (1, False, True, False, False), 5: (0, False, False, False, False)}


def test_captured_ranks(spark):
    rank = "pool_id int, system string, candidate_id int, rank int, original_rank int, score double"
    whole = [(p, "a", c, c, None, c / 8) for p in range(1, 6) for c in (1, 2, 3)]
    part = [(1, "b", 3, 1, 3, 0.375), (2, "b", 9, 1, 3, 0.375), (3, "b", 3, 1, 2, 0.375), (4, "b", 3, 2, 3, 0.375), (5, "b", 3, 1, 3, 0.375), (5, "b", 3, 2, 3, 0.375)]
    systems = [(p, "a", 3, 3, None) for p in range(1, 6)] + [(p, "b", 2 if p == 5 else 1, 5, "a") for p in range(1, 6)] + [(6, "a", 0, 3, None)]
    found = hits.rank_faults(spark.createDataFrame(whole + part, rank), spark.createDataFrame(systems, "pool_id int, system string, returned int, depth int, parent string"))
    assert sorted(map(tuple, found.collect())) == [(2, "b", "parent"), (3, "b", "parent"), (4, "b", "ranks"), (5, "b", "candidates")]


def test_records_are_created_once(spark, tmp_path):
    at = f"file://{tmp_path}/records"
    rows = lambda *ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "id int, payload string")
    create = lambda batch, *ids: sinks.create_records(rows(*ids), at, batch, ["id"], F.col("payload"))
    assert [r.sha for r in create("one", 1).collect()] == [hashlib.sha256(b"p1").hexdigest()]
    for batch, ids, why in (("one", [2], "is recorded"), ("two", [2, 1], "has recorded"), ("two", [3, 3], "repeats")):
        with pytest.raises(Violation, match=why):
            create(batch, *ids)
    create("two", 2, 3)
    assert sorted((r.batch, r.id) for r in spark.read.parquet(at).collect()) == [("one", 1), ("two", 2), ("two", 3)]


def test_a_batch_is_taken_whole_or_not(spark):
    schema = "id int, v array<double>, text string, seq int"
    stored = spark.createDataFrame([(1, [1.0, 0.0], "old"), (2, [0.0, 1.0], "old")], "id int, v array<double>, text string")
    put = lambda *rows: documents.upsert_valid(stored, spark.createDataFrame([*rows], schema), "id", "seq", {"text": F.col("text") != ""}, "v", 2)
    after, n = put((2, [1.0, 1.0], "a", 1), (2, [1.0, 2.0], "b", 2), (3, [1.0, 3.0], "c", 1))
    assert n == 2 and sorted((r.id, r.text) for r in after.collect()) == [(1, "old"), (2, "b"), (3, "c")]
    good = (3, [1.0, 3.0], "c", 2)
    for bad in ((3, [0.0, 0.0], "x", 1), (3, [1.0], "x", 1), (3, [float("nan"), 1.0], "x", 1), (3, [None, 1.0], "x", 1), (3, None, "x", 1), (3, [1.0, float("inf")], "x", 1), (3, [1.0, 1.0], "", 1), (None, [1.0, 1.0], "x", 1)):
        with pytest.raises(Violation):
            put(bad, good)


def test_claims_have_paths_and_backing(spark):
    claim = "struct<refs:array<string>>"
    hyp = f"struct<rationale:{claim},supporting:array<{claim}>,contradicting:array<{claim}>>"
    schema = f"case_id int, facts array<string>, patient_cases array<string>, knowledge array<string>, diagnosis struct<primary:{hyp},differential:array<{hyp}>,treatment:array<{claim}>>"
    one = ((["f2", "f1", "f1"],), [(["m1", "zz"],)], [(["c1"],)])
    rows = [(1, ["f1", "f2"], ["c1"], ["m1"], (one, [((["f1"],), None, [])], [(["m1", "c1"],)])), (2, ["f1"], None, None, (None, None, None)), (3, [], [], [], None)]
    got = [(r.case_id, r.path, r.patient, r.analogous, r.medical, r.supported, r.bare) for r in evaluation.claim_links(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        (1, "/primary_hypothesis/rationale", ["f1", "f2"], [], [], False, False), (1, "/primary_hypothesis/supporting_evidence/0", [], [], ["m1"], True, False), (1, "/primary_hypothesis/contradicting_evidence/0", [], ["c1"], [], False, False),
        (1, "/differential_diagnoses/0/rationale", ["f1"], [], [], False, True), (1, "/treatment/actions/0/proposal", [], ["c1"], ["m1"], True, False),
    ]

"""Sections, query plans, concept joins, pointers, assessments, packing and evaluation: golden values and edges."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import sections


def source(*body):
    return "\n".join(["Topic", "Title", "URL", "Type", *body])


def test_section_spans(spark):
    flat = source("one two", "", "three here", "more", "", "four")
    two = source("intro", "A", "====", "alpha x", "B", "---", "beta y", "C", "===", "gamma z")
    low = source("intro", "A", "---", "alpha x", "B", "--\r", "beta y")
    rules = source("t", "===", "---", "u v")  # the first rule underlines t, so it is no heading over the second
    docs = spark.createDataFrame([(1, flat), (2, two), (3, low), (4, rules), (5, "too\nfew"), (6, None)], "k int, text string")
    asked = [(1, "three"), (2, "beta y"), (2, "gamma"), (3, "alpha"), (4, "u v"), (5, "few"), (6, "x"), (7, "x")]
    spans, faults = sections.section_spans(docs, spark.createDataFrame(asked, "k int, quote string"), "k")
    got = {}
    for r in spans.collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {1: ["three here\nmore"], 2: ["A\n====\nalpha x\nB\n---\nbeta y\nC\n===\ngamma z"], 3: ["A\n---\nalpha x\n"], 4: ["t\n===\n---\nu v"]}
    assert {(r.k, r.fault) for r in faults.collect()} == {(5, "no_body"), (6, "no_body"), (7, "no_body")}
    ask = lambda *q, **k: [(r.k, r.fault) for r in sections.section_spans(docs, spark.createDataFrame([*q], "k int, quote string"), "k", **k)[1].collect()]
    assert ask((1, "o"), (1, "three")) == [(1, "ambiguous")] and ask((1, "five")) == [(1, "missing")] and ask((1, "Topic")) == [(1, "missing")] and ask((1, "")) == [(1, "missing")]
    assert ask((2, "gamma"), budget=10) == [(2, "over_budget")] and ask((2, "gamma"), budget=13) == []


def test_query_plan(spark):
    from siftstone.operators import planning as P
    from siftstone.operators.models import HashingEmbedder

    rows = [
        (1, "presenting_evidence", 0, "Do you have a cough?"), (1, "symptoms", 0, "I feel febrile and coughing"), (1, "symptoms", 1, "Do you sweat? = no"), (1, "symptoms", 2, "How bad? = -2.5"), (1, "symptoms", 3, "is it the"),
        (1, "antecedents", 0, "cough years ago"), (1, "antecedents", 1, "asthma = yes"), (1, "antecedents", 2, "detached from reality"), (2, "symptoms", 0, "nowhere near = Nowhere"),
    ]
    facts = spark.createDataFrame(rows, "case_id int, field string, pos int, text string")
    cases = spark.createDataFrame([(1, 70, "F"), (2, None, None), (3, 7, "M")], "case_id int, age int, sex string")
    ignored = {(r.fact_id, r.reason) for r in P.ignored_facts(facts).filter("case_id = 1").collect()}
    assert ignored == {("patient:symptoms:1", P.NEGATED), ("patient:symptoms:2", P.NEGATED), ("patient:symptoms:3", P.EMPTY)}
    seen = {(r.kind, r.pos): (r.concept, r.text, r.fact_ids) for r in P.observed(facts).collect()}
    assert seen["symptoms", 0] == ("cough", "cough", ["patient:presenting_evidence:0", "patient:symptoms:0"]) and seen["symptoms", 1][0] == "fever"
    assert seen["history", 0][2] == ["patient:antecedents:0"] and seen["history", 2][1] == "feeling detached from body or surroundings"
    plan = {r.query_id: r for r in P.query_plan(facts, cases, HashingEmbedder(64)).collect()}
    assert plan["symptoms:0"].text == "cough; fever" and plan["symptoms:0"].fact_ids == ["patient:presenting_evidence:0", "patient:symptoms:0"]
    assert plan["history:2"].text == "older adult asthma symptoms and clinical information" and set(plan) == {"symptoms:0", "history:1", "history:2", "history:3"}
    told = {r.case_id: r.query for r in P.focused_query(facts, cases).collect()}
    assert told[1].startswith("older adult female cough; fever") and "history: asthma; detachment clinical" in told[1]
    assert told[2] == "clinical information red flags" and told[3] == "pediatric male clinical information red flags"


def test_concepts_by_set_containment(spark):
    from siftstone.operators import planning as P

    texts = spark.createDataFrame([(1, "Side of a chest that hurts"), (2, "the chest, the side of it"), (3, "chest"), (4, None), (5, "racing HEART of the side")], "k int, text string")
    asked = spark.createDataFrame([("chest pain", "side of the chest"), ("chest pain", "chest tightness"), ("heart", "heart racing"), ("heart", "racing heart"), ("chest", "chest"), ("none", "12"), ("absent", "chest zebra")], "concept string, alternative string")
    got = {(r.k, r.concept) for r in P.concept_matches(texts, "k", asked).collect()}
    assert got == {(2, "chest pain"), (5, "heart"), (1, "chest"), (2, "chest"), (3, "chest")}
    plans = spark.createDataFrame([(9, "symptoms", "chest pain"), (9, "symptoms", "chest"), (9, "history", "heart")], "query_id int, kind string, concept string")
    c = spark.createDataFrame([(9, k) for k in (1, 2, 5, 4)], "query_id int, k int")
    body = P.concept_matches(texts, "k", asked)
    reasons = {r.k: r.reason for r in P.concept_gate(c, plans, body.filter("k = 5"), body, "k").collect()}
    assert reasons == {1: "insufficient_concept_overlap", 2: "multiple_symptom_overlap", 5: "topic_title_overlap", 4: "insufficient_concept_overlap"}


def test_hybrid(spark):
    from siftstone.operators import hybrid as H

    queries = spark.createDataFrame([(1, 10, "symptoms", "asthma cough", [1.0, 0.0]), (1, 11, "symptoms", "kidney", [0.0, 1.0]), (1, 12, "history", "zebra", [0.6, 0.8]), (1, 13, "history", "giraffe", [0.8, 0.6])], "case_id int, query_id int, kind string, text string, vector array<double>")
    records = spark.createDataFrame([(1, "asthma cough", [1.0, 0.0]), (2, "Asthma  COUGH", [1.0, 0.0]), (3, "kidney stone", [0.0, 1.0]), (4, "kidney asthma", None)], "doc_id int, text string, vector array<double>")
    rankings = H.channels(queries, records, "doc_id", 2)
    kept, left = H.pool(rankings, records, "doc_id")
    assert {r.doc_id for r in left.collect()} == {2} and {r.doc_id for r in kept.collect()} == {1, 3, 4}
    roles = {(r.doc_id, r.kind): (r.query_id, r.assigned_by) for r in H.assigned(kept, rankings, queries, records, "doc_id").collect()}
    assert roles[1, "symptoms"] == (10, "strength") and roles[3, "symptoms"] == (11, "strength") and roles[1, "history"][1] == "strength"
    # no history query found the kidney asthma record, and it has no vector: the least id
    assert roles[4, "history"] == (12, "dense") and roles[4, "symptoms"] == (11, "strength")


def test_pointers(spark):
    from siftstone.functions import pointers as P

    doc = '{"a/b": {"m~n": ["x y", {"deep": "y"}], "0": "zero"}, "": "e", "n": 3, "none": null, "q\\"\'": "k"}'
    want = {
        ("/a~1b/m~0n/0", "x y"): None, ("/a~1b/m~0n/1/deep", "y"): None, ("/a~1b/0", "er"): None, ("/", "e"): None, ("/q\"'", "k"): None, ("/a~1b/m~0n/0", "z"): "not_quoted", ("/a~1b/m~0n/0", " "): "not_quoted",
        ("", "e"): "invalid_pointer", ("n", "3"): "invalid_pointer", ("/a~b", "x"): "invalid_pointer", (None, "x"): "invalid_pointer", ("/n", "3"): "not_a_string", ("/none", "x"): "not_a_string", ("/a~1b", "x"): "not_a_string",
        ("/a~1b/m~0n/00", "x"): "unknown_pointer", ("/a~1b/m~0n/2", "x"): "unknown_pointer", ("/a~1b/m~0n/-", "x"): "unknown_pointer", ("/n/0", "x"): "unknown_pointer", ("/a~1b/", "x"): "unknown_pointer", ("/a~01b", "x"): "unknown_pointer",
    }
    rows = spark.createDataFrame([(doc, p, x) for p, x in want], "j string, p string, x string").select(F.parse_json("j").alias("d"), "p", "x")
    assert {(r.p, r.x): r.fault for r in rows.select("p", "x", P.quote_fault("d", "p", "x").alias("fault")).collect()} == want


def test_merged_counters(spark):
    from siftstone.operators import evaluation as E

    flat = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 5}), (1, None), (2, {}), (3, {"c": None})], "k int, c map<string,bigint>")
    assert {r.k: r.c for r in E.merged_counters(flat, ["k"], "c").collect()} == {1: {"a": 1, "b": 7}, 2: {}, 3: {"c": None}}
    deep = spark.createDataFrame([(1, {"x": {"a": 1}, "y": {}}), (1, {"x": {"a": 2, "b": 1}})], "k int, c map<string,map<string,bigint>>")
    assert E.merged_counters(deep, ["k"], "c").first().c == {"x": {"a": 3, "b": 1}, "y": {}}


def test_reference_checks(spark):
    from siftstone.operators import evidence as E

    facts = [("p:0", "Do you have a cough? = yes"), ("p:1", "fever = No"), ("p:2", "How fast did it appear = 7"), ("p:3", "no wheezing"), ("p:4", "sweating = 2"), ("p:5", None), ("p:6", "palpitations = not reported")]
    one = spark.createDataFrame(facts, "r string, t string").select("r", E.fact_concepts(F.col("t")).alias("f"))
    told = {r.r: (r.f.concepts, r.f.polarity) for r in one.collect()}
    assert told == {"p:0": (["cough"], "positive"), "p:1": (["fever"], "negative"), "p:2": (["onset_score"], "recorded"), "p:3": (["wheezing"], "negative"), "p:4": ([], "recorded"), "p:5": ([], "unknown"), "p:6": (["palpitations"], "unknown")}
    claims = [
        (1, "Cough; no fever and denies wheezing", ["p:0", "p:1", "p:3"]), (2, "fever", ["p:1"]), (3, "dyspnea and cough", ["p:0"]), (4, "rapid onset speed", ["p:2"]), (5, "cough", ["who:1"]), (6, "may cough. Tired", ["p:0"]), (7, "sweating", ["p:4"]),
    ]
    c = spark.createDataFrame([(0, *x) for x in claims], "case_id int, claim_no int, text string, refs array<string>")
    f = spark.createDataFrame([(0, *x) for x in facts] + [(9, "who:1", "cough")], "case_id int, ref string, text string")
    got = sorted((r.claim_no, r.concept or "", r.result, (r.reason or "")[-17:]) for r in E.reference_checks(c, f).collect())
    match, polarity, concept = "ity_match", "polarity_mismatch", "_concept_mismatch"
    assert [(a, b, d) for a, b, d, _ in got] == [
        (1, "cough", "consistent"), (1, "fever", "consistent"), (1, "wheezing", "consistent"), (2, "fever", "mismatch"), (3, "cough", "consistent"), (3, "dyspnea", "mismatch"), (4, "onset_score", "consistent"),
        (5, "", "unassessed"), (6, "", "unassessed"), (6, "", "unassessed"), (7, "sweating", "mismatch"),
    ]
    reasons = {(a, b): r for a, b, _, r in got}
    assert reasons[1, "cough"].endswith(match) and reasons[2, "fever"] == polarity and reasons[3, "dyspnea"].endswith(concept[1:])


def test_sql_surface(spark):
    from siftstone.functions import sql

    sql.register(spark)
    got = spark.sql("SELECT k, w.index, w.text FROM VALUES (1, 'a b c d e'), (2, ''), (3, NULL), (4, 'x') AS t(k, s), LATERAL word_windows(s, 3, 2) w ORDER BY k, w.index").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a b c"), (1, 1, "c d e"), (4, 0, "x")]
    r = spark.sql("SELECT normalize_nfkc('Ａsthma  x') AS a, tokenize_catalog('Café STRASSE_2') AS b, html_sections('<h1>A</h1><p>x') AS c, normalize_nfkc(NULL) AS d").first()
    assert (r.a, r.b, [tuple(x) for x in r.c], r.d) == ("Asthma x", ["cafe", "strasse", "2"], [("A", "x")], None)


def test_forged_assessments(spark):
    from siftstone.operators import assessment as A

    hyp = [("/primary_hypothesis", "flu", [(["m1"],), (None,)]), ("/differential_diagnoses/0", "cold", [(["p1"],)])]
    cats = [("prohibited_action", "issue_identified", [("/a", "x", ["m1"]), ("/b", "y", None)]), ("unsafe_delay", "uncertain", []), ("safety_ambiguity", "no_issue_identified", [("/z", "z", None)])]
    schema = "run int, flags array<string>, hypotheses array<struct<path:string,condition:string,claims:array<struct<refs:array<string>>>>>, medical array<string>, categories array<struct<category:string,result:string,entries:array<struct<path:string,excerpt:string,refs:array<string>>>>>"
    runs = spark.createDataFrame([(1, [], hyp, ["m1"], cats), (2, ["a", " "], hyp[:1], ["m1"], None), (3, [], [], [], []), (4, None, None, None, None)], schema)
    told = {r.run: r.assessment for r in A.assess(runs).collect()}
    assert [f.finding_id for f in told[1].findings] == ["deterministic:medical:/differential_diagnoses/0", "semantic:prohibited_action:0", "semantic:prohibited_action:1", "semantic:unsafe_delay:0"]
    assert [f.disposition for f in told[1].findings] == ["HUMAN_REVIEW", "BLOCK", "BLOCK", "HUMAN_REVIEW"] and told[1].decision == "BLOCK" and told[1].reasons == ["missing_medical_reference", "prohibited_action", "unsafe_delay"]
    assert (told[2].semantic_status, told[2].decision, [f.path for f in told[2].findings]) == ("skipped_critic_block", "BLOCK", ["/safety_flags/0", None])
    assert told[3].decision == "CONTINUE" and told[3].findings == [] and told[4].decision == "CONTINUE"
    good = A.assess(runs).select("run", F.to_json("assessment").alias("assessment"))
    assert A.forged(runs, good, "run").count() == 0
    edited = good.withColumn("assessment", F.when(F.col("run") == 1, F.replace("assessment", F.lit('"BLOCK"'), F.lit('"CONTINUE"'))).when(F.col("run") == 2, "oops").when(F.col("run") == 3, F.replace("assessment", F.lit('"findings":[],'), F.lit("")))).filter("run < 4")
    assert {r.run: r.fields for r in A.forged(runs, edited, "run").collect()} == {1: ["findings", "decision"], 2: ["unreadable"], 3: ["findings"], 4: ["missing"]}


def test_baseline_preserving_packing(spark):
    from siftstone.operators import packing as P

    def packed(facts, most, count=lambda x: len(x.split())):
        rows = [(1, i, t, s, h) for i, (t, s, h) in enumerate(facts)]
        return P.preserving(spark.createDataFrame(rows, "case_id int, pos int, text string, short string, history boolean"), count, most).first()

    facts = [("Do you have pain in = arm", "pain in", False), ("Do you have pain in = leg", "pain in", False), ("fever", "fever", False), ("cough", "cough", True), ("Do you have pain in = arm", "pain in", False)]
    r = packed(facts, 14)
    assert r.baseline == "Do you have pain in = arm; Do you have pain in = leg" and r.outcome == "extended" and r.query == "pain in = arm | leg; cough; fever" and r.added == ["cough", "fever"] and r.omitted == []
    assert packed(facts[:2], 14).outcome == "compressed" and packed(facts[:2], 14).query == "pain in = arm | leg"
    # a bar that costs more than it saves: the exact baseline, and nothing added
    r = packed(facts, 14, lambda x: len(x.split()) + 20 * x.count("|"))
    assert r.outcome == "baseline_retained" and r.query == r.baseline and r.added == [] and r.omitted == ["fever", "cough"]
    # what does not fit is passed over, and later facts still join
    r = packed([("a b c d e f", "x", False), ("g h i", "x", False), ("j", "j", False)], 4)
    assert r.baseline == "g h i; j" and r.omitted == ["a b c d e f"]


def test_case_measures_null_rules(spark):
    from siftstone.operators import evaluation as E

    hyp = "struct<condition:string,rationale:struct<refs:array<string>>,supporting:array<struct<refs:array<string>>>,contradicting:array<struct<refs:array<string>>>>"
    schema = f"case_id int, status string, truth string, diagnosis struct<primary:{hyp},differential:array<{hyp}>,treatment:array<struct<refs:array<string>>>,unsupported:array<string>>, critique struct<unsupported_points:array<string>,contradictions:array<string>,missing_evidence:array<string>,hallucination_flags:array<string>,safety_flags:array<string>>, facts array<string>, patient_cases array<string>, knowledge array<string>"
    h = lambda c, *refs: (c, (list(refs),), [], [])
    rows = [
        (1, "success", "FLU ", (h("Flu", "f", "bad"), [h("flu"), h("cold", "k")], [(["c"],)], ["u"]), ([], ["x"], [], ["y"], []), ["f"], ["c"], ["k"]),
        (2, "partial", "flu", (h("cold"), [h("flu")], None, []), None, None, None, None), (3, "success", "flu", None, None, ["f"], None, None), (4, "success", None, (h("flu"), [], [], []), None, [], [], []), (5, "success", "flu", (None, [], [], []), None, [], [], []),
        (6, "success", " ", (None, [h("flu")], [], []), None, [], [], []),
    ]
    got = {r.case_id: r for r in E.case_measures(spark.createDataFrame(rows, schema), top_k=1).collect()}
    r = got[1]
    assert (r.measurable, r.accepted_primary_match, r.primary_match, r.citations, r.valid_citations, r.coverage, r.hallucinated, r.unsupported, r.critic_flags, r.critic_hallucinations) == (True, True, True, 4, 3, 0.75, 1, 1, 2, 1)
    assert (got[2].accepted_primary_match, got[2].accepted_top_k_match, got[2].primary_match, got[2].top_k_match, got[2].coverage, got[2].critic_flags) == (False, False, False, False, None, None)
    assert (got[3].measurable, got[3].primary_match, got[3].note, got[3].unsupported, got[3].citations) == (False, None, "no_accepted_diagnosis", None, 0)
    assert (got[4].measurable, got[4].primary_match, got[4].note) == (False, None, None) and (got[5].note, got[5].primary_match, got[5].accepted_primary_match) == ("accepted_abstention", False, None) and got[6].primary_match is None


def test_review_sessions_as_batch_and_stream(spark, sf, tmp_path):
    from siftstone.plans.casework import review_records
    from siftstone.streaming import events, reviews

    records = review_records(spark, sf)
    want = sorted(tuple(r) for r in reviews.review_faults(records).collect())
    faults = {r[3] for r in want}
    assert {None, "hash", "start", "decision_without_review"} <= faults and any(r[4] == "approved" for r in want)
    # a session's records come in several batches: state carries what the next one is held against
    for name, part in (("a", "seq <= 1"), ("b", "seq > 1 and seq <= 3"), ("c", "seq > 3")):
        records.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(reviews.RECORD).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = events.drain(reviews.review_stream(stream), "reviews_out")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_selection_log_holds_by_itself():
    """Every event of a log against what the log itself says was taken before it."""
    import random

    import pandas as pd

    from siftstone.operators import selection as S

    rng = random.Random(7)
    role_of = {"history": "history_", "symptoms": "symptoms_"}
    for _ in range(60):
        rows = []
        for i in range(rng.randint(1, 12)):
            sy, hi = rng.choice([None, -1.0, 0.0, 1.0, 2.0]), rng.choice([None, None, 0.5, 1.5, -2.0])
            rows.append({
                "query_id": "q", "chunk_id": f"c{i:02}", "parent_id": f"p{rng.randint(0, 8)}", "document_id": f"d{rng.randint(0, 3)}", "section": rng.choice(["A", "a ", "B", None]), "rrf": rng.choice([0.1, 0.2]), "symptoms_score": sy, "history_score": hi,
                "symptoms_ranking": None if sy is None else sy + rng.choice([0, 0.3]), "history_ranking": None if hi is None else hi + rng.choice([0, 0.3]), "history_query": rng.choice([None, "h1", "h2"]), "mismatch": rng.choice([True, False]), "tokens": rng.sample("abcdefgh", rng.randint(0, 3)),
            })
        frame = pd.DataFrame(rows).astype({f"{r}_{c}": float for r in ("symptoms", "history") for c in ("score", "ranking")})
        by, limit = {r["chunk_id"]: r for r in rows}, rng.randint(0, 5)
        log = S.choose(frame, limit)
        walks = [[e for e in log if e[1] == "symptoms"]]
        n_history = sum(r["history_score"] is not None for r in rows)
        history = [e for e in log if e[1] == "history"]
        first = history[:n_history] if limit > 1 else []
        assert len(history) == n_history * (2 if limit > 1 else 1) and len(walks[0]) == sum(r["symptoms_score"] is not None for r in rows)
        taken: list[dict] = []
        for k, (chunk, role, _, event) in enumerate(log):
            r, room = by[chunk], 1 if k < len(first) else limit
            alike = [len({*r["tokens"]} & {*o["tokens"]}) / max(1, len({*r["tokens"]} | {*o["tokens"]})) for o in taken]
            want = [
                len(taken) >= room and "limit", r[role_of[role] + "score"] <= 0 and "nonpositive", any(o["parent_id"] == r["parent_id"] for o in taken) and "section_taken",
                sum(o["document_id"] == r["document_id"] for o in taken) >= 2 and "document_full", any(a >= 0.8 for a in alike) and "near_duplicate",
            ]
            assert event == next(filter(None, want), "selected")
            if event == "selected":
                taken.append(r)
        for walk in (first, walks[0], history[len(first):]):
            order = [(-by[c][role_of[role] + "ranking"], -by[c]["rrf"], c) for c, role, _, _ in walk]
            assert order == sorted(order)

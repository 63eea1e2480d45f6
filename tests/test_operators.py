"""Golden values and edges of operators that the registered queries do not show."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftstone.functions import ids, urls
from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import cases, constraints, documents, evaluation, evidence, models, packing, ranking, selection, workflow
from siftstone.sources import html, readers, sinks
from siftstone.streaming import events as ev


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, tx.clean_nfkc(F.col("t")), t="Ａsthma\n  wheezing\t") == "Asthma wheezing"
    assert one(spark, tx.catalog_tokens(F.col("t")), t="Anæmia Café STRASSE_2") == ["anæmia", "cafe", "strasse", "2"]
    assert one(spark, tx.compact_question(F.col("t")), t="Have you ever had asthma?") == "ever had asthma"
    assert one(spark, tx.concepts(F.col("t")), t="Do you cough? = No") == []
    assert one(spark, tx.concepts(F.col("t")), t="Trouble with a wheeze and febrile nights") == ["fever", "wheezing"]
    assert one(spark, tx.concepts(F.col("t")), t="stomach cramps at night = 7") == []
    assert one(spark, tx.joined(F.col("t")), t=["a", "b", "c"]) == "a, b and c" and one(spark, tx.joined(F.col("t")), t=[]) == ""
    assert one(spark, tx.excerpt(F.col("t"), 6), t="ab\ncd\nefgh") == "ab\ncd" and one(spark, tx.plain_label(F.col("t")), t="see E_12 x") is None
    import uuid

    assert one(spark, ids.uuid5(F.col("t")), t="a/b") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b"))


def test_urls(spark):
    at = lambda u: one(spark, urls.canonical(F.col("t"), ["www.site.org", "site.org"], "/detail/"), t=u)
    assert at("http://site.org/detail/asthma/?q=1#x") == "https://www.site.org/detail/asthma"
    assert at("https://other.org/detail/asthma") is None and at("https://site.org/detail/a%2Fb") is None and at("ftp://site.org/detail/a") is None
    assert one(spark, urls.file_name(F.col("t")), t="con") == "_con.txt"
    assert one(spark, urls.open_licence(F.col("t")), t="https://creativecommons.org/licenses/by-nc/4.0/") is None


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(0, "asthma wheezing"), (1, "kidney kidney"), (2, "asthma")], "doc_id long, text string")
    ask = lambda q: [(r.doc_id, round(r.score, 6)) for r in ranking.bm25(docs, spark.createDataFrame([(0, q)], "query_id long, query string")).orderBy("rank").collect()]
    assert ask("unknownword") == [] and ask("asthma") == ask("asthma asthma") == [(2, 0.573175), (0, 0.431196)]


def test_rrf_golden(spark):
    r = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 2)], "query_id long, channel string, doc_id long, rank int")
    assert ranking.rrf(r, ["query_id"], "doc_id").first().rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-12)
    assert ranking.fusion_faults(r.union(r.limit(1)), ["query_id"], "doc_id").count() == 1


def test_relevance_golden(spark):
    label = {0: "relevant", 9: "relevant", 49: "relevant", 55: "relevant", 19: "partially_relevant"}
    c = spark.createDataFrame([(i, label.get(i, "not_relevant"), True) for i in range(61)], "candidate_id long, label string, reviewed boolean")
    lists = {"current": list(range(50)), "symptom": list(range(5, 55)), "lexical": [19, 0, 40, 49, 9]}
    s = spark.createDataFrame([(i, k, r, len(v)) for k, v in lists.items() for r, i in enumerate(v, 1)], "candidate_id long, system string, rank int, depth int")
    strict = {r.system: r for r in evaluation.relevance(c, s).collect()}
    assert [strict["current"][f"recall_{k}"] for k in (5, 10, 20, 50)] == [0.25, 0.5, 0.5, 0.75] and strict["current"].mrr == 1.0 and strict["symptom"].mrr == 0.2
    assert strict["lexical"].recall_5 == 0.75 and strict["lexical"].mrr == 0.5
    wide = {r.system: r for r in evaluation.relevance(c, s, "inclusive").collect()}
    assert [wide["current"][f"recall_{k}"] for k in (5, 10, 20, 50)] == [0.2, 0.4, 0.6, 0.8] and wide["lexical"].mrr == 1.0
    unseen = evaluation.relevance(c.withColumn("reviewed", F.lit(False)), s).first()
    assert unseen.recall_5 is None and unseen.n_positive is None and unseen.mrr is None


def pool(spark, scores):
    return spark.createDataFrame([("q", f"c{i}", f"p{i}", f"d{i}", "", 0.5, s, None, s, None, None, None, [f"w{i}"]) for i, s in enumerate(scores)], selection.POOL)


def test_selection(spark):
    chosen = lambda scores, **k: [r.chunk_id for r in selection.select_evidence(pool(spark, scores), 5, **k).filter("event = 'selected'").orderBy("step").collect()]
    assert chosen([-5.0] * 4) == [] and chosen([3.0, -5.0, -5.0]) == ["c0"] and chosen([1.0, 3.0, 2.0]) == ["c1", "c2", "c0"]
    groups = selection.average_link([[1.0, 0.0]] * 17, 4)
    assert sum(map(len, groups)) == 17 and max(map(len, groups)) <= 4
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["a", "d"])], "row_no long, items array<string>")
    assert selection.diverse(items, 3) == [1, 3, 4]


def background(spark, rows):
    """Rows (chunk, document, section, symptoms, history, history query, mismatch) with words of their own."""
    full = [("q", c, f"p{c}", d, sec, 0.5 - i / 100, sy, hi, sy, hi, hq, m, [f"w{c}"]) for i, (c, d, sec, sy, hi, hq, m) in enumerate(rows)]
    return spark.createDataFrame(full, selection.POOL)


def test_selection_variants(spark):
    def chosen(rows, variant="base", **k):
        got = selection.select_evidence(background(spark, rows), 5, variant, **k).orderBy("step").collect()
        return [(r.chunk_id, r.role) for r in got if r.event == "selected"], {(r.chunk_id, r.role): r for r in got}

    rows = [("a", "d1", "Causes", 3.0, None, None, False), ("b", "d2", "Causes", 2.0, 5.0, "h1", True), ("c", "d2", "causes ", None, 4.0, "h1", False), ("d", "d2", "Signs", None, 3.0, "h1", False), ("e", "d3", "Signs", None, 2.0, "h1", False), ("f", "d4", "", None, 1.0, "h2", False)]
    base, log = chosen(rows)
    assert base == [("b", "history"), ("a", "symptoms"), ("c", "history"), ("e", "history"), ("f", "history")] and log["d", "history"].event == "document_full"
    # the last pass is left out
    assert chosen(rows, "background_cap_1")[0] == [("b", "history"), ("a", "symptoms")]
    # a query that was served is served again only by a new section of the same document
    novel, log = chosen(rows, "history_novelty")
    assert novel == [("b", "history"), ("a", "symptoms"), ("d", "history"), ("f", "history")]
    assert log["c", "history"].event == log["e", "history"].event == "redundant_history"
    # a mismatch costs a half of ranking and nothing of eligibility
    near = [("a", "d1", "", 3.0, None, None, True), ("b", "d2", "", 2.6, None, None, False), ("c", "d3", "", 0.2, None, None, True)]
    assert [c for c, _ in chosen(near)[0]] == ["a", "b", "c"]
    penal, log = chosen(near, "population_penalty")
    assert [c for c, _ in penal] == ["b", "a", "c"] and log["c", "symptoms"].ranking == pytest.approx(-0.3)
    # twice the score orders the rows and lets none through that was not positive
    heavy = [("a", "d1", "", -2.0, None, None, False), ("b", "d2", "", 1.0, None, None, False)]
    told, log = chosen(heavy, "symptoms_weight_2")
    assert told == [("b", "symptoms")] and log["a", "symptoms"].ranking == -4.0 and log["a", "symptoms"].event == "nonpositive"
    many = [(f"c{i}", f"d{i}", "", 9.0 - i, None, None, False) for i in range(8)]
    assert len(chosen(many)[0]) == 5 and len(chosen(many, unbounded=True)[0]) == 8
    changed = selection.selection_changes(selection.select_variants(background(spark, rows), 5))
    assert {(r.variant, r.chunk_id, r.change) for r in changed.collect()} == {
        ("background_cap_1", "c", "lost"), ("background_cap_1", "e", "lost"), ("background_cap_1", "f", "lost"), ("history_novelty", "c", "lost"), ("history_novelty", "e", "lost"), ("history_novelty", "d", "gained"),
    }
    with pytest.raises(ValueError, match="columns"):
        selection.select_evidence(background(spark, rows).drop("mismatch"), 5, "population_penalty")
    with pytest.raises(ValueError, match="variant"):
        selection.select_evidence(background(spark, rows), 5, "other")


def test_routing_truth_table(spark):
    cases_ = [
        (0, "supported_with_limitations", 0, 1, 0, "FINAL"), (0, "revision_required", 0, 1, 1, "DIAGNOSTIC_REVISION"), (0, "revision_required", 0, 1, 2, "UNRESOLVED"),
        (1, "insufficient_evidence", 0, 1, 2, "BLOCKED"), (0, "supported_with_limitations", 0, 0, 0, "ABSTENTION"), (0, "revision_required", 0, 0, 2, "UNRESOLVED"), (0, "insufficient_evidence", 3, 1, 0, "ABSTENTION"),
    ]
    d = spark.createDataFrame(cases_, "f int, a string, i int, h int, r int, want string")
    assert all(x.got == x.want for x in d.select("want", workflow.route(F.col("f"), F.col("a"), F.col("i"), F.col("h"), F.col("r"))["next_stage"].alias("got")).collect())


def test_transitions(spark):
    bad = [("DIAGNOSTIC", "CRITIC"), ("DIAGNOSTIC_REVISION", "FINAL"), ("PATIENT", "DIAGNOSTIC"), ("GROUNDING", "FINAL"), ("FINAL", "TERMINAL_FAILURE")]
    good = [("INITIAL", "PATIENT"), ("CRITIC", "ROUTE"), ("CRITIC", "TERMINAL_FAILURE")]
    rows = [(f"r{k}", n, s) for k, pair in enumerate(bad + good) for n, s in enumerate(pair)]
    got = workflow.illegal_steps(spark.createDataFrame(rows, "run string, n int, stage string"), "run", [F.asc("n")], "stage", workflow.edges(spark), workflow.TERMINAL)
    assert {r.run for r in got.collect()} == {f"r{k}" for k in range(len(bad))}


def test_constraints_fail_closed(spark):
    d = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    found = constraints.violations(d, {"small": F.col("v") < 10}, ["k"])
    assert [(r.k, r.rule) for r in found.collect()] == [(2, "small")]
    with pytest.raises(constraints.Violation):
        constraints.assert_valid(found)
    with pytest.raises(Exception, match="constraint broken"):
        constraints.checked(d, {"small": F.col("v") < 10}).collect()


def test_case_decode(spark, tmp_path):
    (tmp_path / "ev.json").write_text(json.dumps({
        "E_1": {"question_en": "Fever?", "data_type": "B", "is_antecedent": False, "value_meaning": {}}, "E_130": {"question_en": "What color is the rash?", "data_type": "C", "is_antecedent": False, "value_meaning": {"V_86": {"en": "dark"}}},
        "E_3": {"question_en": "How bad?", "data_type": "C", "is_antecedent": False, "value_meaning": {}}, "E_2": {"question_en": "Smoker?", "data_type": "B", "is_antecedent": True, "value_meaning": {}},
    }))
    dim, values = readers.evidence_dimensions(spark, str(tmp_path / "ev.json"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("release_train_patients", "AGE,SEX,EVIDENCES,INITIAL_EVIDENCE,PATHOLOGY,DIFFERENTIAL_DIAGNOSIS\n18,m,\"['E_1', 'E_2', 'E_130_@_V_86', 'E_3_@_4', 'E_3_@_4']\",E_1,x,y\nx,?,\"['E_9', 'E_3_@_1', 'E_3_@_2']\",E_3,x,y\n")
    (tmp_path / "c.zip").write_bytes(buffer.getvalue())
    raw = readers.zipped_cases(spark, str(tmp_path / "c.zip"), "train")
    assert "pathology" not in raw.columns and readers.zipped_labels(spark, str(tmp_path / "c.zip"), "train").count() == 2
    told = readers.case_columns(raw).orderBy("row_no").collect()
    assert [(r.age_years, r.sex_code) for r in told] == [(18, "M"), (None, None)]
    decoded = cases.decode(raw.select(F.col("row_no").cast("string").alias("case_id"), cases.listed(F.col("evidences")).alias("evidences")), dim, values)
    got = [(r.code, r.answer, r.fault) for r in decoded.orderBy("case_id", "pos").collect()]
    assert got == [("E_1", "Yes", None), ("E_2", "Yes", None), ("E_130", "dark", None), ("E_3", "4", None), ("E_9", None, "unknown_code"), ("E_3", "1", "conflict"), ("E_3", "2", "conflict")]
    assert "- What color is the rash? = dark" in cases.render(decoded.filter("fault is null")).filter("case_id = '1'").first().text
    with pytest.raises(Exception, match="one member"):
        readers.zipped_cases(spark, str(tmp_path / "c.zip"), "test").collect()


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text("""<health-topics total="4"><health-topic id="100" title="Asthma" url="u1" language="English"><full-summary>&lt;p&gt;x&lt;/p&gt;</full-summary></health-topic>
<health-topic id="200" title="Asma" url="u2" language="Spanish"><full-summary>y</full-summary></health-topic><health-topic id="300" title="B" url="u3" language="English"></health-topic><health-topic id="400" title="C" url="u4" language="English"><full-summary> </full-summary></health-topic></health-topics>""")
    got, counts = readers.topics(spark, str(tmp_path / "t.xml"))
    c = counts.first()
    assert [r.id for r in got.collect()] == [100] and (c.total, c.english, c.other_language, c.parsed, c.without_summary) == (4, 3, 1, 1, 2)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.xml").write_text('<article><front><article-meta><article-id pub-id-type="pmc">1</article-id><article-title>A <i>b</i></article-title><permissions><license href="l"/></permissions></article-meta><abstract><p>abs</p></abstract></front><body><sec><p>one</p><fig><p>no</p></fig></sec><ref-list><p>no</p></ref-list></body></article>')
    r = readers.articles(spark, str(tmp_path / "a")).first()
    assert r.title == "A b" and [s.text for s in r.sections] == ["abs", "one"] and r.ids == {"pmc": "1"} and r.licence == "l"


def test_catalog_vignette_and_files(spark, tmp_path):
    d = tmp_path / "cat"
    d.mkdir()
    (d / "1.txt").write_text("Topic: Asthma\nTitle: T\nURL: u\nType: x\n====\nBody\ntext")
    (d / "2.txt").write_text("broken")
    good, bad = readers.catalog(spark, str(d))
    assert good.first().body == "Body\ntext" and bad.first().fault == "header"
    text = "note\nSymptoms:\n- fever\n- no cough\nHistory\n* asthma"
    got = one(spark, readers.vignette(F.col("t"), ["Symptoms", "History"]), t=text)
    assert [(x.section, x.pos, x.line) for x in got] == [("Symptoms", 0, "fever"), ("Symptoms", 1, "no cough"), ("History", 0, "asthma")]
    files = readers.binary(spark, str(d))
    assert readers.inventory(files).count() == 2 and readers.utf8(files).count() == 2
    with pytest.raises(Exception, match="too large"):
        readers.bounded(files, 10).collect()


def test_paged(spark):
    rows = [json.dumps({"k": i}) for i in range(25)]
    got = readers.paged(spark, lambda top, skip: (25, rows[skip : skip + top]), page=10).collect()
    assert sorted(r.position for r in got) == list(range(25))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "k int, name string, v int")
    sinks.json_lines(d, str(tmp_path / "j"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":1,"name":"a","v":3}', '{"k":2,"name":"b","v":null}']
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.json_lines(d, str(tmp_path / "j"), ["k"])
    with pytest.raises(ValueError):
        sinks.write_apart(d, d, str(tmp_path / "s"), ["name"])
    sinks.publish(d, str(tmp_path / "p"), "1", lambda x: x.filter("k > 9"))
    with pytest.raises(constraints.Violation):
        sinks.publish(d, str(tmp_path / "p"), "2", lambda x: x.filter("k > 1"))
    assert sinks.current(spark, str(tmp_path / "p")).count() == 2 and "| 1 | a | 3 |" in sinks.report(d, "R")


def test_sections_and_chunks(spark):
    s = spark.createDataFrame([(1, [("A", "short one"), ("B", "short two"), ("C", "w " * 200)])], "doc_id int, s array<struct<title:string,text:string>>")
    got = s.select(documents.merge_sections(F.col("s")).alias("m")).first().m
    assert [x.title for x in got] == ["A / B", "C"]
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, ""), (3, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_index) for r in documents.chunks(d).orderBy("doc_id", "chunk_index").collect()] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert html.read_sections("<h1>A</h1><p>x<script>n</script></p><nav>m</nav><h2>B</h2>y") == [("A", "x"), ("B", "y")]


def test_packing_skips_and_goes_on(spark):
    assert one(spark, packing.pack(F.col("t"), 6), t=["aaa", "toolongforit", "bb"]) == ["aaa", "bb"]


def test_consistency(spark):
    claims = spark.createDataFrame([(1, "Patient has a cough; no fever.", ["r1", "r2"]), (2, "May have fever", ["r1"]), (3, "cough", [])], "id int, text string, refs array<string>")
    facts = spark.createDataFrame([("r1", "cough", "recorded"), ("r2", "fever", "positive")], "ref string, concept string, polarity string")
    got = {(r.id, r.concept): r.status for r in evidence.consistency(claims, facts, "id").collect()}
    assert got == {(1, "cough"): "no_mismatch_in_checked_observations", (1, "fever"): "mismatch", (2, "fever"): "unassessed", (3, "cough"): "unassessed"}


def test_models(spark):
    v = models.embed(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), models.HashingEmbedder(8), "k", "t")
    assert v.filter(vec.unit_length(F.col("embedding"))).count() == 1
    models.same_signature(v, models.HashingEmbedder(8))
    with pytest.raises(ValueError):
        models.same_signature(v, models.HashingEmbedder(16))


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        batch.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ev.read(spark, str(tmp_path / "in"), 10)
    got = ev.drain(ev.tumbling(stream), "tumbling_out", "complete")
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r.event_type, r.n) for r in got.collect()) == sorted((r.event_type, r.n) for r in want.collect())
    steps = ev.drain(ev.state_machine(stream, {"view": ["click", "view"]}, ["error"], 5, 1e9), "machine_out")
    assert steps.count() == batch.count()
    n = {r.user_id: r.n for r in batch.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r.user_id: r.m for r in steps.groupBy("user_id").agg(F.max("requests").alias("m")).collect()} == n
    first = {r.user_id: r.f for r in steps.filter("requests = 1").groupBy("user_id").agg(F.count("fault").alias("f")).collect()}
    assert set(first.values()) == {0}
    assert ev.drain(ev.distinct(stream, ["event_id"]), "distinct_out").count() == batch.count()


def test_catalog(spark):
    from siftstone.operators import catalog

    rows = [(1, "Asthma", [["asthma"]], ["asthma"]), (2, "Asthma care", [["asthma", "care"]], ["asthma", "care"]), (3, "Gaming disorder", [["gaming", "disorder"], ["gaming", "disorder", "facts"]], ["gaming", "disorder"]), (4, "Care", [["primary", "care"]], ["primary", "care"])]
    e = spark.createDataFrame([(i, t, "fact", f"{i}.txt", f"u{i}", p, w) for i, t, p, w in rows], "entry_id int, topic string, kind string, file string, url string, phrases array<array<string>>, terms array<string>")
    ask = lambda q: [(r.entry_id, r.match) for r in catalog.lookup(e, spark.createDataFrame([(1, q, q.split())], "query_id int, query string, words array<string>"), ["the", "of"]).orderBy("rank").collect()]
    assert ask("asthma") == [(1, "exact"), (2, "partial")] and ask("the gaming disorder of") == [(3, "topic_phrase")] and ask("unrelated words") == []
    with pytest.raises(Exception, match="too long"):
        ask("asthma " * 1000)
    aliases = spark.createDataFrame([("all", 1), ("all topics", 2), ("heart attack", 3), ("attack", 4)], "alias string, topic_id int")
    q = spark.createDataFrame([(1, "ALL TOPICS all day".split()), (2, "ALL of a Heart Attack".split())], "query_id int, words array<string>")
    got = {(r.query_id, r.topic_id) for r in catalog.alias_matches(q, aliases, ["all"]).collect()}
    assert got == {(1, 2), (2, 1), (2, 3)}
    assert one(spark, catalog.sentence_windows(F.col("t"), 5), t="One two. Three four. Five six seven.") == ["One two. Three four.", "Five six seven."]

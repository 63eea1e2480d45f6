"""Sources, sinks, collections and services over the tables: what is written is read back, and files are made from rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.functions import text as tx
from siftstone.operators import cases as cs
from siftstone.operators import catalog as ca
from siftstone.operators import evaluation as em
from siftstone.operators import ranking as rk
from siftstone.operators import services as sv
from siftstone.operators import workflow as wf
from siftstone.operators.models import HashingEmbedder
from siftstone.plans.base import query, t
from siftstone.plans.retrieval import BM25_SQL, _bm25
from siftstone.plans.texts import _CLEAN, _ENTITIES, _bare_sql
from siftstone.plans.workflows import _ALLOWED, _PAIRS, _events
from siftstone.session import workspace
from siftstone.sources import html as ht
from siftstone.sources import readers as rd
from siftstone.sources import sinks as sk


def _files(spark, sf):
    """Documents as binary rows: path, length, content."""
    content = F.encode("text", "UTF-8")
    return t(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), content.alias("content"))


@query("s1_zipped_cases", "SELECT row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS row_no, (18 + c_custkey % 70)::VARCHAR AS age, ['M', 'F', ' m ', 'x'][(c_custkey % 4 + 1)::INT] AS sex, ['M', 'F', 'M', NULL][(c_custkey % 4 + 1)::INT] AS sex_code, c_name || ', \"' || c_mktsegment || '\"' AS evidences FROM customer")
def zipped(spark, sf):
    """ZIP files of a hundred cases at most, made from customers, and read as streams of CSV rows."""
    import csv
    import io
    import zipfile

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        text = io.StringIO()
        w = csv.writer(text)
        w.writerow(["AGE", "SEX", "EVIDENCES", "INITIAL_EVIDENCE", "PATHOLOGY"])
        for r in rows.sort_values("c_custkey").itertuples():
            w.writerow([18 + r.c_custkey % 70, ["M", "F", " m ", "x"][r.c_custkey % 4], f'{r.c_name}, "{r.c_mktsegment}"', "E_1", "hidden"])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("release_train_patients", text.getvalue())
        return pd.DataFrame({"content": [out.getvalue()]})

    files = t(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).applyInPandas(pack, "content binary")
    rows = rd.zipped_rows(files, "train", ["AGE", "SEX", "EVIDENCES", "INITIAL_EVIDENCE"], rd.CASES)
    return rd.case_columns(rows).select("row_no", "age", "sex", "sex_code", "evidences")


@query("s2_json_dictionary", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey AS region FROM nation")
def dictionary(spark, sf):
    at = workspace(spark) + "/dictionary"
    one = t(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))))).alias("value"))
    one.coalesce(1).write.text(at)  # a file of one object: 25 nations
    return rd.dictionary(spark, at, "name string, region int").select("key", "value.name", "value.region")


@query("s3_a22_inventory", "SELECT 'docs/' || doc_id || '.txt' AS path, strlen(text) AS length, sha256(text) AS sha256 FROM documents")
def inventory(spark, sf):
    return rd.inventory(_files(spark, sf))


@query("s4_s5_topics", "SELECT n_nationkey::BIGINT AS id, n_name AS title, 'English' AS language, 'about ' || n_name AS summary FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 5 <> 3")
def topics(spark, sf):
    """A topic file with a name space: other languages and topics without a summary are left out."""
    at = workspace(spark) + "/topics"
    n = t(spark, sf, "nation")
    language = F.when(F.col("n_regionkey") == 2, "Spanish").otherwise("English")
    summary = F.when(F.col("n_nationkey") % 5 == 3, "  ").otherwise(F.concat(F.lit("about "), "n_name"))
    rows = n.select("n_nationkey", F.format_string('<m:health-topic id="%d" title="%s" url="u%d" language="%s"><m:full-summary>%s</m:full-summary></m:health-topic>', "n_nationkey", "n_name", "n_nationkey", language, summary).alias("x"))
    whole = rows.agg(F.concat(F.lit('<m:health-topics xmlns:m="urn:x">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "x"))), lambda r: r["x"]), "\n"), F.lit("</m:health-topics>")).alias("value"))
    whole.coalesce(1).write.text(at)
    return rd.topics(spark, at)[0].select("id", "title", "language", "summary")


_PLAIN = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


@query("s6_articles", f"WITH d AS (SELECT doc_id, {_PLAIN} AS x FROM documents) SELECT 'PMC' || doc_id AS pmc, 'Title ' || doc_id AS title, 'https://creativecommons.org/licenses/by/4.0/' AS licence, 2 AS n, md5('abs ' || doc_id || '|' || x) AS digest FROM d WHERE x <> ''")
def journal(spark, sf):
    """Articles with front matter, a figure and references around their text."""
    x = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    d = t(spark, sf, "documents").withColumn("x", x).filter("x <> ''")
    k = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="pmc">PMC'), k, F.lit("</article-id><title-group><article-title>Title <i>"), k,
        F.lit('</i></article-title></title-group><permissions><license xlink:href="https://creativecommons.org/licenses/by/4.0/"/></permissions><abstract><p>abs '), k,
        F.lit("</p></abstract></article-meta></front><body><sec><p>"), F.col("x"), F.lit("</p><fig><p>a figure</p></fig></sec></body><back><ref-list><p>a reference</p></ref-list></back></article>"),
    )
    read = rd.article_rows(d.select(F.concat(k, F.lit(".xml")).alias("path"), F.encode(xml, "UTF-8").alias("content")))
    return read.select(F.col("ids")["pmc"].alias("pmc"), "title", "licence", F.size("sections").alias("n"), F.md5(F.array_join(F.transform("sections", lambda s: s["text"]), "|")).alias("digest"))


@query("s7_utf8_texts", "SELECT 'docs/' || doc_id || '.txt' AS path, md5(text) AS digest FROM documents WHERE trim(text) <> ''")
def utf8(spark, sf):
    files = _files(spark, sf).filter(F.trim(F.col("content").cast("string")) != "")
    return rd.utf8(files).select("path", F.md5("text").alias("digest"))


@query("s10_bounded_files", "SELECT count(*) AS files, max(strlen(text)) AS longest FROM documents")
def bounded(spark, sf):
    return rd.bounded(_files(spark, sf), 1 << 30).agg(F.count("*").alias("files"), F.max("length").alias("longest"))


@query("s15_paged_service", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_suppkey AS id FROM supplier")
def paged(spark, sf):
    """A service that hands out suppliers in pages, read a page to a partition."""
    told = [r["s_suppkey"] for r in t(spark, sf, "supplier").select("s_suppkey").orderBy("s_suppkey").toLocalIterator()]  # the service's own memory, not the engine's

    def fetch(top: int, skip: int):
        return len(told), [f'{{"id": {k}}}' for k in told[skip : skip + top]]

    return rd.paged(spark, fetch, 40, 100_000).select("position", F.from_json("json", "id long")["id"].alias("id"))


@query("f11_listed_codes", "SELECT c_custkey, 'E_' || (c_custkey % 7) AS first, 2 + (c_custkey % 2)::INT AS n FROM customer")
def listed(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit("['E_"), (k % 7).cast("string"), F.lit("', 'E_9_@_V_1'"), F.when(k % 2 == 1, ", 'E_8'").otherwise(""), F.lit("]"))
    return t(spark, sf, "customer").select("c_custkey", cs.listed(text).alias("l")).select("c_custkey", F.get("l", 0).alias("first"), F.size("l").alias("n"))


_LINES = "regexp_replace(regexp_replace(replace(regexp_replace(inner_, '\\s+', ' ', 'g'), '<br>', chr(10)), '</?p>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in _ENTITIES.items():
    _LINES = f"replace({_LINES}, '{_entity}', '{_char}')"
_LINES = f"trim(regexp_replace(regexp_replace({_LINES}, '[ ]*\\n[ ]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("f15_articles", f"""WITH a AS (SELECT page_id, html, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '(?s)<h1>.*?</h1>', '') AS inner_ FROM pages), b AS (SELECT page_id, {_bare_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, {_LINES} AS body FROM a)
SELECT page_id, nullif(title, '') AS title, md5(nullif(body, '')) AS digest, length(nullif(body, ''))::INT AS n FROM b""")
def articles(spark, sf):
    """Title and body of each page's article, with lists and headings in text form."""
    return t(spark, sf, "pages").select("page_id", ht.article(F.col("html")).alias("a")).select("page_id", "a.title", F.md5("a.body").alias("digest"), F.length("a.body").alias("n"))


@query("f17_sentence_windows", r"""WITH RECURSIVE s AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM conversations),
n AS (SELECT conv_id, turn, list_transform(l, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))) AS c FROM s),
w AS (SELECT conv_id, turn, c, 0 AS i, 0::BIGINT AS used, 0 AS windows FROM n UNION ALL SELECT conv_id, turn, c, i + 1, CASE WHEN windows > 0 AND used + c[i + 1] <= 400 THEN used + c[i + 1] ELSE c[i + 1] END, CASE WHEN windows > 0 AND used + c[i + 1] <= 400 THEN windows ELSE windows + 1 END FROM w WHERE i < len(c))
SELECT conv_id, turn, windows, used::INT AS last_words FROM w WHERE i = len(c) AND len(c) > 0""")
def sentence_windows(spark, sf):
    """Sentences folded into windows of 400 words at most."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", ca.sentence_windows(F.col("text"), 400).alias("w")).filter(F.size("w") > 0)
    return c.select("conv_id", "turn", F.size("w").alias("windows"), F.size(F.filter(F.split(F.element_at("w", -1), r"\s+"), lambda x: x != "")).alias("last_words"))


@query("j18_alias_matches", """WITH q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ') AS ws FROM part), w AS (SELECT query_id, ws, unnest(range(0, len(ws)))::INT AS i FROM q),
m AS (SELECT query_id, ws, i, 1 AS n FROM w WHERE lower(ws[i + 1]) IN (SELECT lower(string_split(p_name, ' ')[1]) FROM part WHERE p_partkey % 50 = 0) UNION ALL
 SELECT query_id, ws, i, 2 FROM w WHERE i + 1 < len(ws) AND lower(ws[i + 1] || ' ' || ws[i + 2]) IN (SELECT lower(string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2]) FROM part WHERE p_partkey % 50 = 1)),
k AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.query_id = a.query_id AND b.n > a.n AND b.i <= a.i AND b.i + b.n >= a.i + a.n)) SELECT query_id, lower(array_to_string(ws[i + 1 : i + n], ' ')) AS alias, i AS start FROM k""")
def aliases(spark, sf):
    """Names of one and of two words in the names of parts: the longer match takes the place of the shorter."""
    p = t(spark, sf, "part").withColumn("w", F.split("p_name", " "))
    queries = p.select(F.col("p_partkey").alias("query_id"), F.col("w").alias("words"))
    one = p.filter("p_partkey % 50 = 0").select(F.lower(F.get("w", 0)).alias("alias"))
    two = p.filter("p_partkey % 50 = 1").select(F.lower(F.concat_ws(" ", F.get("w", 0), F.get("w", 1))).alias("alias"))
    names = one.union(two).distinct().withColumn("topic_id", F.col("alias"))
    return ca.alias_matches(queries, names, []).select("query_id", "alias", "start")


@query("v8_alias_diagnostics", """SELECT p_partkey AS query_id, lower(p_brand) AS alias, p_partkey % 3 <> 0 AS applied, lower(p_brand) IN ('brand#1', 'brand#2') AS watched FROM part""")
def alias_diagnostics(spark, sf):
    """Proposed source titles against those that the expanded query really has, with words to watch marked."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.lower("p_brand").alias("alias"), F.concat(F.lit("Title of "), F.lower("p_brand")).alias("title"))
    expanded = F.concat("query", F.lit("\nSource topic: "), F.when(F.col("query_id") % 3 != 0, F.concat("title", F.lit("; Other"))).otherwise(F.lit("Other")))
    return ca.alias_diagnostics(p.withColumn("expanded", expanded), ["brand#1", "brand#2"])


@query("k2_audit_records", "SELECT user_id, event_id, sha256(event_type || '|' || props) AS sha FROM events WHERE event_type = 'error'")
def audit_records(spark, sf):
    at = workspace(spark) + "/audit"
    e = t(spark, sf, "events").filter("event_type = 'error'").select("user_id", "event_id", F.concat_ws("|", "event_type", "props").alias("payload"), (F.col("event_id") % 2).alias("session"))
    for part in (0, 1):  # two appends: what is there stays
        sk.append_record(e.filter(F.col("session") == part), at, "session", F.col("payload"))
    return spark.read.parquet(at).select("user_id", "event_id", "sha")


@query("k3_json_lines", """SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' AS line FROM customer""")
def json_sink(spark, sf):
    at = workspace(spark) + "/lines"
    sk.json_lines(t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), at, ["c_custkey"])
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("k4_features_and_labels", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def apart(spark, sf):
    at = workspace(spark) + "/apart"
    sk.write_apart(t(spark, sf, "documents").select("doc_id", "lang"), t(spark, sf, "labels").select("doc_id", "quality"), at, ["quality", "toxic"])
    return spark.read.parquet(f"{at}/features").join(spark.read.parquet(f"{at}/labels"), "doc_id").select("doc_id", "lang", "quality")


@query("k6_published_version", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def published(spark, sf):
    """Of three versions the second has faults and is never current, the third takes the first one's place."""
    from siftstone.operators.constraints import Violation, violations

    at = workspace(spark) + "/published"
    c = t(spark, sf, "customer").select("c_custkey", "c_name")
    faults = lambda d: violations(d, {"name": F.col("c_name") != ""}, ["c_custkey"])
    sk.publish(c, at, "1", faults)
    try:
        sk.publish(c.withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))), at, "2", faults)
    except Violation:
        pass
    first = sk.current(spark, at)
    sk.publish(first.filter("c_custkey % 2 = 0"), at, "3", faults)
    return sk.current(spark, at)


@query("k8_report_lines", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT unnest(['# Nations', '', '| n_nationkey | n_name |', '|-|-|'])")
def report(spark, sf):
    told = sk.report(t(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "Nations")
    return spark.createDataFrame([(x,) for x in told.rstrip("\n").split("\n")], "line string")


@query("k9_x28_index_of_files", "SELECT 't' || p_partkey AS topic, p_name AS title, 'https://example.org/' || p_partkey AS url, 't' || p_partkey || '.txt' AS file FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def file_index(spark, sf):
    """An index made from headed texts alone: files under another name than their topic's, and files without a header, are not in it."""
    k = F.col("p_partkey").cast("string")
    head = F.concat(F.lit("Topic: t"), k, F.lit("\nTitle: "), "p_name", F.lit("\nURL: https://example.org/"), k, F.lit("\nKind: sheet\n=====\nbody of "), k)
    files = t(spark, sf, "part").select(F.concat(F.lit("out/"), F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(F.concat(F.lit("t"), k)), F.lit(".txt")).alias("path"), F.when(F.col("p_partkey") % 7 == 0, "no header").otherwise(head).alias("value"))
    return rd.index_of(files)


@query("x2_x3_k7_collection", "SELECT unnest([0, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> '' AND quality = 1), 0]) AS before, unnest([(SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> '' AND quality = 1), (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> ''), (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> '' AND quality = 0)]) AS after, unnest([1, 2, 3]) AS step")
def collection(spark, sf):
    """A collection is built from one part of the rows, then from all of them, then reset and built from the others."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").filter(F.trim("text") != "").select("doc_id", "text", "quality", F.lit("train").alias("split"))
    c, model = sv.Collection(spark, workspace(spark) + "/collection"), HashingEmbedder(32)
    steps = []
    for step, rows in enumerate((d.filter("quality = 1"), d, d.filter("quality = 0")), 1):
        if step == 3:
            c.reset()
        steps.append((step, *c.build(rows, model, "doc_id", "text").select("before", "after").first()))
    return spark.createDataFrame(steps, "step int, before long, after long")


@query("t14_frozen_evidence", BM25_SQL + """, h AS (SELECT query_id, rank, doc_id FROM bm WHERE rank <= 5) SELECT query_id, count(*) AS n_rows, sha256(string_agg(rank || chr(9) || doc_id || chr(9) || sha256(text), chr(10) ORDER BY rank)) AS snapshot_id FROM h JOIN documents USING (doc_id) GROUP BY query_id""")
def frozen_evidence(spark, sf):
    """Evidence of five documents a query, retrieved once: asked again over a corpus that lost rows, the service answers as before."""
    at = workspace(spark) + "/evidence"
    texts = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    search = lambda: _bm25(spark, sf, 5).join(texts, "doc_id").select("query_id", F.col("doc_id").alias("source_id"), "rank", "text_sha")
    sv.EvidenceService(spark, at, search).retrieve()
    return sv.EvidenceService(spark, at, lambda: search().filter("rank = 1")).snapshots()


@query("t7_run_outcomes", f"""WITH e AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, min(n) FILTER (before IS NOT NULL AND (before = 'error' OR (before, event_type) NOT IN ({_PAIRS}))) AS illegal, min(n) FILTER (spent > 400) AS over, count(*) AS events, arg_max(event_type, n) AS last FROM e GROUP BY 1)
SELECT user_id, events, CASE WHEN illegal IS NOT NULL AND (over IS NULL OR illegal <= over) THEN 'ILLEGAL' WHEN over IS NOT NULL THEN 'BUDGET' ELSE last END AS outcome, least(illegal, over) AS stopped_at FROM f""")
def run_outcomes(spark, sf):
    """Each run to its end: the first illegal step or the first breach of the budget stops it, else its last stage stands."""
    return wf.outcomes(_events(spark, sf), "user_id", [F.asc("ts"), F.asc("event_id")], "event_type", wf.edges(spark, _ALLOWED), ["error"], "value", 400)


@query("x8_case_state", "SELECT c_custkey, 'patient:symptoms:0' AS ref, c_mktsegment AS text FROM customer UNION ALL SELECT c_custkey, 'patient:symptoms:1', c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'patient:history:0', 'nation ' || c_nationkey FROM customer")
def case_state(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.array_compact(F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))).alias("symptoms"), F.array(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("history"))
    return sv.state_of(c, "c_custkey", ["symptoms", "history"])


@query("x9_content_bound_ids", """SELECT c_custkey, 'manual:' || sha256('{"age":' || (c_custkey % 90) || ',"history":null,"symptoms":["' || c_mktsegment || '"]}') AS id FROM customer""")
def content_ids(spark, sf):
    record = ids.canonical_json(symptoms=F.array("c_mktsegment"), age=F.col("c_custkey") % 90, history=F.lit(None).cast("string"))
    return t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("manual:"), ids.digest(record)).alias("id"))


@query("x26_attached_plan", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, 'plan ' || o_orderpriority AS plan FROM orders")
def attached(spark, sf):
    doc = F.struct(F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("plan"), F.col("o_totalprice").alias("price"))
    plan = F.concat(F.lit("plan "), "o_orderpriority")
    return t(spark, sf, "orders").select("o_orderkey", sv.attached(doc, "plan", plan, F.length(plan) > 5).alias("d")).select("o_orderkey", "d.status", "d.price", "d.plan")


@query("x22_evidence_summary", "SELECT source, count(*) AS accepted, count(DISTINCT lang) AS languages, min(doc_id) AS first, string_agg(DISTINCT lang, ',' ORDER BY lang) AS named FROM documents WHERE doc_id % 3 = 0 GROUP BY 1")
def evidence_summary(spark, sf):
    d = t(spark, sf, "documents").filter("doc_id % 3 = 0")
    return d.groupBy("source").agg(F.count("*").alias("accepted"), F.countDistinct("lang").alias("languages"), F.min("doc_id").alias("first"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("named"))


@query("x27_review_context", """WITH f AS (SELECT user_id, count(*) FILTER (value > 100) AS n, string_agg(event_id, ',' ORDER BY event_id) FILTER (event_type = 'error') AS w FROM events GROUP BY 1), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1)
SELECT user_id, latest, n AS findings, coalesce(w, '') AS warnings, CASE WHEN n > 0 THEN 'HUMAN_REVIEW' ELSE 'ALLOW' END AS decision FROM f JOIN l USING (user_id)""")
def review_context(spark, sf):
    """All that a reviewer sees of a run in one row: its latest stage, findings, warnings and decision; nothing is cut."""
    e = _events(spark, sf)
    warnings = F.array_join(F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))).cast("array<string>"), ",")
    by = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count_if(F.col("value") > 100).alias("findings"), warnings.alias("warnings"))
    return by.withColumn("decision", F.when(F.col("findings") > 0, "HUMAN_REVIEW").otherwise("ALLOW"))


@query("x30_script_settings", "SELECT page_id, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS track FROM pages")
def script_settings(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.coalesce(rd.script_setting(F.col("html"), "track"), F.lit("")).alias("track"))


@query("x34_selector_comparison", BM25_SQL + """, a AS (SELECT query_id, doc_id FROM bm WHERE rank <= 3), b AS (SELECT query_id, doc_id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7919) % 101 DESC, doc_id) <= 3)
SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS baseline_only, count(*) FILTER (a.doc_id IS NULL) AS selector_only FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY 1""")
def selector_comparison(spark, sf):
    """Three documents a query by the lexical baseline, and by another selector over the same pool."""
    pool = _bm25(spark, sf)
    other = rk.top(pool.withColumn("s", (F.col("doc_id") * 7919) % 101).drop("rank"), ["query_id"], [F.desc("s"), F.asc("doc_id")], 3)
    return em.compared(pool.filter("rank <= 3").select("query_id", "doc_id"), other.select("query_id", "doc_id"), "query_id", "doc_id")


@query("x19_payload_kinds", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(text) >= 40 THEN 'sections' ELSE 'sections_invalid' END ELSE CASE WHEN n_chars = length(text) THEN 'excerpt' ELSE 'excerpt_invalid' END END AS kind FROM documents")
def payload_kinds(spark, sf):
    """Payloads are checked by the rules of their own kind, which a field names."""
    d = t(spark, sf, "documents").withColumn("selection", F.when(F.col("doc_id") % 2 == 0, "sections").otherwise("excerpt"))
    rules = {"sections": F.length("text") >= 40, "excerpt": F.col("n_chars") == F.length("text")}
    kind = F.coalesce(*[F.when(F.col("selection") == k, F.when(ok, F.lit(k)).otherwise(F.lit(f"{k}_invalid"))) for k, ok in rules.items()])
    return d.select("doc_id", kind.alias("kind"))


@query("m7_average_links", "WITH f AS (SELECT vec_id // 12 AS c, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.c::BIGINT AS case_id, round(avg(list_dot_product(a.v, b.v)), 9) AS link, count(*) AS pairs FROM f a JOIN f b ON a.c = b.c AND a.vec_id % 12 < 6 AND b.vec_id % 12 >= 6 GROUP BY 1")
def average_links(spark, sf):
    """The mean product between the two halves of each case: the measure that average-link grouping merges by."""
    from siftstone.functions import vectors as vec

    v = t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("case_id"), (F.col("vec_id") % 12 < 6).alias("left"), F.col("embedding").alias("v"))
    a, b = v.filter("left").select("case_id", F.col("v").alias("x")), v.filter("not left").select("case_id", F.col("v").alias("y"))
    return a.join(b, "case_id").groupBy("case_id").agg(F.round(F.avg(vec.dot(F.col("x"), F.col("y"))), 9).alias("link"), F.count("*").alias("pairs"))


@query("p6_document_constraints", f"SELECT doc_id, unnest(list_filter([CASE WHEN {_CLEAN} = '' THEN 'text' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN source IS NULL OR NOT regexp_matches(source, '^src[0-9]+$') THEN 'source' END, CASE WHEN n_chars <> length(text) THEN 'n_chars' END, CASE WHEN doc_id < 0 THEN 'doc_id' END], lambda x: x IS NOT NULL)) AS rule FROM documents")
def document_constraints(spark, sf):
    from siftstone.operators.constraints import violations

    rules = {"text": tx.clean(F.col("text")) != "", "lang": F.col("lang").isin("en", "de", "fr"), "source": F.col("source").rlike("^src[0-9]+$"), "n_chars": F.col("n_chars") == F.length("text"), "doc_id": F.col("doc_id") >= 0}
    return violations(t(spark, sf, "documents"), rules, ["doc_id"])

"""Audits with two sides over the tables: what is stored is rebuilt from its source, with faults planted by id on the stored side.

The planted faults are stated once for each query, in the DataFrame and in its SQL, so a check that cannot fail does not match.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.functions import text as tx
from siftstone.operators import audit as au
from siftstone.operators import constraints as co
from siftstone.operators import documents as dc
from siftstone.operators import evidence as ev
from siftstone.operators import ranking as rk
from siftstone.operators import workflow as wf
from siftstone.plans.base import query, t
from siftstone.plans.retrieval import _L2, BM25_SQL, _bm25, _queries, _vectors
from siftstone.plans.texts import _CLEAN, _WIN


def _mod(column: str, by: int, is_: int):
    return F.col(column) % by == is_


def _uuid_sql(h: str) -> str:
    return f"left({h}, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)))::INT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _name_sql(doc: str, index: str, text: str) -> str:
    return f"sha1(unhex('{ids.URL_SPACE}') || encode('medical-knowledge/' || {doc} || '/{dc.VERSION}/' || {index} || '/' || sha256({text})))"


#: ex: chunks as their sources give them; st: the same as stored, with faults.
_INDEX = f"""{_WIN}, e0 AS (SELECT doc_id, chunk_index::INT AS chunk_index, text, {_name_sql('doc_id', 'chunk_index', 'text')} AS h FROM ch),
ex AS (SELECT doc_id, chunk_index, text, {_uuid_sql('h')} AS chunk_id FROM e0),
s0 AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 47 = 5 THEN 'x' || substr(chunk_id, 2) ELSE chunk_id END AS chunk_id, CASE WHEN doc_id % 37 = 3 THEN text || ' x' WHEN doc_id % 43 = 2 THEN '' ELSE text END AS text,
 CASE WHEN doc_id % 53 = 1 THEN '' ELSE 'https://example.org/' || doc_id END AS url FROM ex WHERE doc_id % 41 <> 7),
s1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s0 WHERE doc_id % 59 = 4),
s2 AS (SELECT *, {_name_sql('doc_id', 'chunk_index', 'text')} AS h FROM s1),
st AS (SELECT *, {_uuid_sql('h')} AS own_id FROM s2),
ve AS (SELECT chunk_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 61 = 2 THEN x * 1.01 ELSE x END) AS v FROM ex JOIN embeddings ON vec_id = doc_id),
fa AS (SELECT st.chunk_id, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY st.chunk_id) > 1 THEN 'duplicate_id' END, CASE WHEN trim(st.text) = '' THEN 'empty_chunk' END, CASE WHEN st.chunk_id <> own_id THEN 'wrong_id' END,
 CASE WHEN ex.chunk_id IS NULL THEN 'unknown_to_source' END, CASE WHEN ex.chunk_id IS NOT NULL AND (ex.text <> st.text OR ex.doc_id <> st.doc_id OR ex.chunk_index <> st.chunk_index) THEN 'differs_from_source' END,
 CASE WHEN url = '' THEN 'missing_provenance' END, CASE WHEN v IS NULL THEN 'missing_vector' END, CASE WHEN v IS NOT NULL AND (len(v) <> 64 OR abs(list_dot_product(v, v) - 1) > 0.0001) THEN 'invalid_vector' END], lambda x: x IS NOT NULL)) AS fault
 FROM st LEFT JOIN ex ON ex.chunk_id = st.chunk_id LEFT JOIN ve ON ve.chunk_id = st.chunk_id
 UNION ALL SELECT chunk_id, 'not_stored' FROM ex WHERE chunk_id NOT IN (SELECT chunk_id FROM st))"""


def _index(spark, sf):
    """(stored, expected, vectors): an index of all documents' chunks with planted faults, its sources, and vectors."""
    expected = dc.chunks(t(spark, sf, "documents"))
    text = F.when(_mod("doc_id", 37, 3), F.concat("text", F.lit(" x"))).when(_mod("doc_id", 43, 2), "").otherwise(F.col("text"))
    name = F.when(_mod("doc_id", 47, 5), F.concat(F.lit("x"), F.expr("substring(chunk_id, 2)"))).otherwise(F.col("chunk_id"))
    url = F.when(_mod("doc_id", 53, 1), "").otherwise(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")))
    stored = expected.filter(~_mod("doc_id", 41, 7)).select("doc_id", "chunk_index", name.alias("chunk_id"), text.alias("text"), url.alias("url"))
    vectors = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(_mod("vec_id", 61, 2), x * 1.01).otherwise(x)).alias("embedding"))
    return stored.unionByName(stored.filter(_mod("doc_id", 59, 4))), expected, expected.select("doc_id", "chunk_id").join(vectors, "doc_id").drop("doc_id")


@query("v1_index_faults", f"WITH {_INDEX} SELECT chunk_id, fault FROM fa")
def index_faults(spark, sf):
    return au.index_faults(*_index(spark, sf), 64)


@query("v1_v2_index_audit", f"WITH {_INDEX}, whole AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(*) - count(DISTINCT text) AS duplicate_chunks FROM st) SELECT documents, chunks, duplicate_chunks, "
       + ", ".join(f"(SELECT count(*) FROM fa WHERE fault = '{k}') AS {k}" for k in au.INDEX_FAULTS) + ", (SELECT count(*) FROM fa) = 0 AND duplicate_chunks = 0 AS passed FROM whole")
def index_audit(spark, sf):
    stored, expected, vectors = _index(spark, sf)
    return au.index_audit(stored, au.index_faults(stored, expected, vectors, 64))


@query("p7_recomputed_ids", f"WITH {_INDEX} SELECT doc_id, chunk_index, chunk_id = own_id AS same FROM st")
def recomputed(spark, sf):
    return _index(spark, sf)[0].select("doc_id", "chunk_index", (F.col("chunk_id") == au.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text"))).alias("same"))


@query("x4_exact_counts", "SELECT 'documents' AS collection, true AS present, count(*) AS n FROM documents UNION ALL SELECT 'vectors', true, count(*) FROM embeddings UNION ALL SELECT 'drafts', false, NULL")
def exact_counts(spark, sf):
    return au.collections([("documents", t(spark, sf, "documents")), ("vectors", t(spark, sf, "embeddings")), ("drafts", None)])


#: Scored rows of a run: one of each (order, line), with the parts of their ranking value.
_SCORED = """x AS (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey}) AS m FROM lineitem GROUP BY ALL),
sc AS (SELECT l_orderkey, l_linenumber, m.p AS p, m.s AS s, (m.p % 21 - 10)::DOUBLE / 7 AS logit, round((m.p % 21 - 10)::DOUBLE / 7 + 0.5 * (m.s % 5) / greatest(1, m.p % 7) + 0.1 * 0.25 + 0.1 * (1.0::DOUBLE / (60 + l_linenumber)) + 0.2 * (m.p % 2), 9) AS value FROM x)"""


def _scored(spark, sf):
    x = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", F.col("m.l_partkey").alias("p"), F.col("m.l_suppkey").alias("s"))
    logit = (F.col("p") % 21 - 10).cast("double") / 7
    value = rk.role_ranking(logit, F.col("s") % 5, F.col("p") % 7, F.lit(0.25), 1.0 / (60 + F.col("l_linenumber")), F.col("p") % 2)
    return x.withColumn("logit", logit).withColumn("value", F.round(value, 9))


@query("v3_replay", f"""WITH {_SCORED}, a AS (SELECT l_orderkey, l_linenumber, logit, CASE WHEN l_orderkey % 97 = 5 THEN value + 0.001 ELSE value END AS value FROM sc WHERE l_orderkey % 89 <> 3), b AS (SELECT * FROM sc WHERE l_orderkey % 83 <> 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN a.l_orderkey IS NULL OR b.l_orderkey IS NULL THEN 'row' ELSE 'value' END AS field,
 CASE WHEN a.l_orderkey IS NULL THEN 'not_stored' WHEN b.l_orderkey IS NULL THEN 'not_reproduced' ELSE 'value' END AS fault FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR abs(a.value - b.value) > 1e-6""")
def replayed(spark, sf):
    fresh = _scored(spark, sf)
    saved = fresh.filter(~_mod("l_orderkey", 89, 3)).withColumn("value", F.when(_mod("l_orderkey", 97, 5), F.col("value") + 0.001).otherwise(F.col("value")))
    return au.replay(saved, fresh.filter(~_mod("l_orderkey", 83, 1)), ["l_orderkey", "l_linenumber"], ["logit", "value"], 1e-6)


@query("v9_run_controls", f"""WITH {_SCORED}, f AS (SELECT l_orderkey % 6 AS run, l_orderkey, l_linenumber, value FROM sc),
s AS (SELECT run, l_orderkey, l_linenumber, CASE WHEN run = 2 AND l_orderkey % 1000 = 2 THEN value + 1 ELSE value END AS value FROM f WHERE NOT (run = 4 AND l_orderkey % 500 = 4)),
d AS (SELECT run FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f) UNION SELECT run FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s)) SELECT DISTINCT run, run NOT IN (SELECT run FROM d) AS exact FROM f""")
def run_controls(spark, sf):
    fresh = _scored(spark, sf).withColumn("run", F.col("l_orderkey") % 6)
    moved = (F.col("run") == 2) & _mod("l_orderkey", 1000, 2)
    saved = fresh.filter(~((F.col("run") == 4) & _mod("l_orderkey", 500, 4))).withColumn("value", F.when(moved, F.col("value") + 1).otherwise(F.col("value")))
    return au.controls(saved, fresh, "run", ["l_orderkey", "l_linenumber", "value"])


@query("x16_baseline_control", f"""WITH {_SCORED}, a AS (SELECT *, value > 0.5 AS chosen FROM sc), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 9 THEN logit + 0.00005 ELSE logit END AS logit, CASE WHEN l_orderkey % 997 = 9 THEN NOT value > 0.5 ELSE value > 0.5 END AS chosen FROM sc)
SELECT count(*) = (SELECT count(*) FROM sc) AS same_pairs, round(max(abs(a.logit - b.logit)), 9) AS drift, count(*) FILTER ((a.logit > 0) <> (b.logit > 0)) AS flips, bool_and(a.chosen = b.chosen) AS same_selection,
 count(*) = (SELECT count(*) FROM sc) AND max(abs(a.logit - b.logit)) <= 0.0001 AND count(*) FILTER ((a.logit > 0) <> (b.logit > 0)) = 0 AND bool_and(a.chosen = b.chosen) AS passed FROM a JOIN b USING (l_orderkey, l_linenumber)""")
def baseline(spark, sf):
    a = _scored(spark, sf).withColumn("chosen", F.col("value") > 0.5)
    b = a.withColumn("logit", F.when(_mod("l_orderkey", 101, 9), F.col("logit") + 0.00005).otherwise(F.col("logit"))).withColumn("chosen", F.when(_mod("l_orderkey", 997, 9), ~F.col("chosen")).otherwise(F.col("chosen")))
    return au.baseline_control(a, b, ["l_orderkey", "l_linenumber"], "logit", "chosen")


@query("l7_score_substitution", f"""WITH {_SCORED}, r AS (SELECT l_orderkey, l_linenumber, value AS before, round(value - logit + (s % 19 - 9)::DOUBLE / 7, 9) AS after FROM sc)
SELECT l_orderkey, l_linenumber, after, row_number() OVER (PARTITION BY l_orderkey ORDER BY before DESC, l_linenumber) - row_number() OVER (PARTITION BY l_orderkey ORDER BY after DESC, l_linenumber) AS moved FROM r""")
def substitution(spark, sf):
    """Other scores in place of the first ones: the value that hangs on them is made anew, and so is the order."""
    r = _scored(spark, sf).withColumn("after", F.round(F.col("value") - F.col("logit") + (F.col("s") % 19 - 9).cast("double") / 7, 9))
    a = rk.top(r, ["l_orderkey"], [F.desc("value"), F.asc("l_linenumber")], None, "first")
    b = rk.top(a, ["l_orderkey"], [F.desc("after"), F.asc("l_linenumber")], None, "second")
    return b.select("l_orderkey", "l_linenumber", "after", (F.col("first") - F.col("second")).alias("moved"))


@query("v5_source_spans", """WITH s AS (SELECT doc_id, (doc_id % 7 * 3)::INT AS start, (doc_id % 7 * 3 + CASE WHEN doc_id % 29 = 2 THEN 1000000 ELSE 25 END)::INT AS "end", substr(text, (doc_id % 7 * 3 + 1)::INT, 25) || CASE WHEN doc_id % 31 = 4 THEN '!' ELSE '' END AS quoted FROM documents),
o AS (SELECT doc_id, text FROM documents WHERE doc_id % 23 <> 1), f AS (SELECT s.doc_id, start, "end", CASE WHEN o.doc_id IS NULL THEN 'no_source' WHEN "end" > length(text) THEN 'out_of_range' WHEN substr(text, start + 1, "end" - start) <> quoted THEN 'altered' END AS fault FROM s LEFT JOIN o USING (doc_id))
SELECT * FROM f WHERE fault IS NOT NULL""")
def source_spans(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    start = (F.col("doc_id") % 7 * 3).cast("int")
    quoted = F.concat(ev.span_text(F.col("text"), start, start + 25), F.when(_mod("doc_id", 31, 4), "!").otherwise(""))
    spans = d.select("doc_id", start.alias("start"), (start + F.when(_mod("doc_id", 29, 2), 1000000).otherwise(25)).alias("end"), quoted.alias("quoted"))
    return au.span_faults(spans, d.filter(~_mod("doc_id", 23, 1)), "doc_id")


@query("v6_request_accounting", """WITH h AS (SELECT user_id, count(*) - (user_id % 19 = 4)::INT AS handed FROM events WHERE user_id % 23 <> 5 GROUP BY user_id), a AS (SELECT user_id, count(*) AS requests FROM events WHERE event_type <> 'signup' OR user_id % 29 <> 6 GROUP BY user_id)
SELECT coalesce(a.user_id, h.user_id) AS user_id, coalesce(requests, 0) AS requests, coalesce(handed, 0) AS handed, coalesce(requests, 0) = coalesce(handed, 0) AS equal FROM a FULL JOIN h ON a.user_id = h.user_id""")
def accounting(spark, sf):
    """Requests in the log against the last running total that each run handed on."""
    e = t(spark, sf, "events").withColumn("one", F.lit(1).cast("long"))
    told = wf.running(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], n="one").groupBy("user_id").agg(F.max("n").alias("n"))
    handed = told.filter(~_mod("user_id", 23, 5)).select("user_id", (F.col("n") - _mod("user_id", 19, 4).cast("int")).alias("requests"))
    return au.accounting(e.filter((F.col("event_type") != "signup") | ~_mod("user_id", 29, 6)), handed, "user_id")


@query("p10_span_integrity", """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'http' ELSE 'https' END || '://example.org/' || doc_id AS url, (doc_id % 5 * 7)::INT AS a, least(length(text), doc_id % 5 * 7 + 30)::INT AS b, substr(text, (doc_id % 5 * 7 + 1)::INT, 30) || CASE WHEN doc_id % 13 = 2 THEN 'z' ELSE '' END AS quoted, text FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN url NOT LIKE 'https://%' THEN 'url' END, CASE WHEN length(quoted) <> b - a THEN 'length' END, CASE WHEN b <= a OR substr(text, a + 1, b - a) <> quoted THEN 'text' END], lambda x: x IS NOT NULL)) AS rule FROM h""")
def span_integrity(spark, sf):
    a = (F.col("doc_id") % 5 * 7).cast("int")
    d = t(spark, sf, "documents").withColumn("a", a).withColumn("b", F.least(F.length("text"), F.col("a") + 30)).withColumn("quoted", F.concat(ev.span_text(F.col("text"), F.col("a"), F.col("a") + 30), F.when(_mod("doc_id", 13, 2), "z").otherwise("")))
    d = d.withColumn("url", F.concat(F.when(_mod("doc_id", 17, 3), "http").otherwise("https"), F.lit("://example.org/"), F.col("doc_id").cast("string")))
    return co.violations(d, {"url": F.col("url").startswith("https://"), "length": F.length("quoted") == F.col("b") - F.col("a"), "text": ev.span_holds(F.col("text"), F.col("a"), F.col("b"), F.col("quoted"))}, ["doc_id"])


@query("p25_consistent_pairs", f"""WITH n AS (SELECT q.vec_id AS query_id, e.vec_id, round({_L2}, 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 9), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10),
s AS (SELECT *, -distance + CASE WHEN vec_id % 17 = 3 THEN 0.001 ELSE 0 END AS score, CASE WHEN vec_id % 23 = 4 THEN rank + 1 ELSE rank END AS told FROM n)
SELECT query_id, vec_id, CASE WHEN abs(score + distance) > 1e-9 THEN 'score' ELSE 'rank' END AS fault FROM s WHERE abs(score + distance) > 1e-9 OR told <> rank""")
def consistent(spark, sf):
    """Stored hits whose score is not the negative distance, or whose rank is not their place by distance."""
    v, q = _vectors(spark, sf)
    hits = rk.knn(v, q, 10, "l2").withColumnRenamed("score", "distance")
    s = hits.withColumn("score", -F.col("distance") + F.when(_mod("vec_id", 17, 3), 0.001).otherwise(0.0)).withColumn("told", F.when(_mod("vec_id", 23, 4), F.col("rank") + 1).otherwise(F.col("rank")))
    fault = F.when(F.abs(F.col("score") + F.col("distance")) > 1e-9, "score").when(F.col("told") != F.col("rank"), "rank")
    return s.select("query_id", "vec_id", fault.alias("fault")).filter("fault is not null")


@query("x1_rebuilt_sections", """WITH r AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw FROM conversations GROUP BY 1), n AS (SELECT conv_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS raw FROM r)
SELECT conv_id, conv_id % 11 <> 4 AS same FROM n""")
def rebuilt(spark, sf):
    """Sections read anew from their JSON source against the approved text, white space apart; some approved texts were changed."""
    c = t(spark, sf, "conversations")
    raw = c.select("conv_id", F.to_json(F.struct("turn", "text")).alias("line"))
    read = raw.select("conv_id", F.from_json("line", "turn long, text string").alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), " ").alias("read"))
    kept = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " \n ").alias("kept"))
    approved = kept.withColumn("kept", F.when(_mod("conv_id", 11, 4), F.concat("kept", F.lit(" more"))).otherwise(F.col("kept")))
    return read.join(approved, "conv_id").select("conv_id", (tx.clean(F.col("read")) == tx.clean(F.col("kept"))).alias("same"))


@query("x6_fact_inventory", """SELECT o_custkey AS case_id, o_orderpriority AS text, min(o_orderkey) AS pos, string_agg('fact:' || o_orderkey, ',' ORDER BY o_orderkey) AS refs, CASE WHEN regexp_matches(o_orderpriority, 'urgent|high', 'i') THEN 'Medications' ELSE 'Symptoms' END AS role FROM orders GROUP BY 1, 2
UNION ALL SELECT c_custkey, 'Segment: ' || c_mktsegment, -1, 'customer:' || c_custkey, 'Context' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def fact_inventory(spark, sf):
    """Equal facts of a case once, with all their references and a role, and one row of context for each case."""
    o = t(spark, sf, "orders")
    refs = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("fact:"), k.cast("string"))), ",")
    facts = o.groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("text")).agg(F.min("o_orderkey").alias("pos"), refs.alias("refs"))
    facts = facts.withColumn("role", F.when(F.col("text").rlike("(?i)urgent|high"), "Medications").otherwise("Symptoms"))
    c = t(spark, sf, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    return facts.unionByName(c.select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("Segment: "), "c_mktsegment").alias("text"), F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("refs"), F.lit("Context").alias("role")))


_UNIT20 = "q AS (SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings WHERE vec_id % 20 = 0)"


@query("x38_split_leakage", f"""WITH {_UNIT20}, h AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.u), 9) DESC, vec_id) AS rank FROM embeddings e, q QUALIFY rank <= 10)
SELECT query_id, count(*) FILTER (rank <= CASE WHEN query_id % 60 = 0 THEN 8 ELSE 10 END) AS hits, count(*) FILTER (rank <= CASE WHEN query_id % 60 = 0 THEN 8 ELSE 10 END AND vec_id % 45 IN (10, 11, 12)) AS leaked, query_id % 60 <> 0 AS complete FROM h GROUP BY query_id""")
def leakage(spark, sf):
    """Hits of held-out queries over an index into which rows of another split were mixed; some answers are cut short."""
    v, q = _vectors(spark, sf)
    index = v.withColumn("split", F.when((F.col("vec_id") % 45).isin(10, 11, 12), "validate").otherwise("train"))
    hits = rk.knn(v, q, 10).filter((F.col("rank") <= 8) | ~_mod("query_id", 60, 0))
    return au.leakage(hits, index, q, 10)


# Wording of claims: two or three clauses each, on observations, negation, unknown and involved wording.
_SAID = (
    "Patient denies coughing; fever is present", "Mild cough but no fever", "Chest tightness. Shortness of breath may follow", "Wheezing was not reported, sweating is marked", "No chest pain! Palpitations and racing heart",
    "Numbness in both hands however no tingling", "The rash is new", "Febrile and coughing", "Choking unless upright; afraid of dying", "Difficulty breathing\nunknown onset speed", "Depersonalization is absent", "",
)


@query("f26_observations", f"""WITH s AS (SELECT c_custkey, [{', '.join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _SAID)}][(c_custkey % {len(_SAID)} + 1)::INT] AS said FROM customer),
c AS (SELECT c_custkey, list_filter(list_transform(string_split_regex(said, '(?i)[.;!?\\n]+|\\bbut\\b|\\bhowever\\b'), lambda x: trim(x)), lambda x: x <> '') AS l FROM s),
p AS (SELECT c_custkey, unnest(range(0, len(l)))::INT AS clause_no, unnest(l) AS clause FROM c)
SELECT c_custkey, clause_no, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(clause, '{p}', 'i') THEN '{k}' END" for k, p in ev.OBSERVATIONS.items())}], lambda x: x IS NOT NULL), ',') AS concepts,
 CASE WHEN regexp_matches(clause, '{ev.INVOLVED}', 'i') THEN 'involved' WHEN regexp_matches(clause, '{ev.UNKNOWN}', 'i') THEN 'unknown' WHEN regexp_matches(clause, '{ev.NEGATIVE}', 'i') THEN 'negative' ELSE 'positive' END AS polarity FROM p""")
def observations(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("c_custkey") % len(_SAID) + 1).cast("int"))
    c = t(spark, sf, "customer").select("c_custkey", F.posexplode(ev.clauses(said)).alias("clause_no", "clause"))
    return c.select("c_custkey", "clause_no", F.array_join(ev.observations(F.col("clause")), ",").alias("concepts"), ev.polarity(F.col("clause")).alias("polarity"))


@query("s12_vignette_sections", """SELECT c_custkey, 'Patient' AS section, 0 AS pos, c_name AS line FROM customer UNION ALL SELECT c_custkey, 'Patient', 1, 'nation ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'Symptoms', 0, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'History', 0, 'since ' || (1990 + c_custkey % 30) FROM customer""")
def vignettes(spark, sf):
    """Notes with headings, bullets of two kinds, blank lines and a line before the first heading, read back into sections."""
    from siftstone.sources.readers import vignette

    k = F.col("c_custkey")
    note = F.concat_ws(
        "\n", F.lit("a line that belongs nowhere"), F.lit("Patient:"), F.concat(F.lit("- "), "c_name"), F.lit("  "), F.concat(F.lit("* nation "), F.col("c_nationkey").cast("string")), F.lit("Symptoms"),
        F.when(k % 3 != 0, F.concat(F.lit("  -  "), "c_mktsegment")), F.lit("History:"), F.concat(F.lit("since "), (1990 + k % 30).cast("string")),
    )
    return t(spark, sf, "customer").select("c_custkey", F.explode(vignette(note, ["Patient", "Symptoms", "History"])).alias("s")).select("c_custkey", "s.section", "s.pos", "s.line")


@query("p18_scalar_allowlist", """SELECT event_id, unnest(['value', 'delta', 'first']) AS name, unnest([CASE WHEN value >= 0 THEN round(value, 6) END, CASE WHEN value - 20 >= 0 THEN round(value - 20, 6) END, CASE WHEN event_id % 2 = 0 THEN 1.0 WHEN event_id % 3 = 0 THEN NULL ELSE 0.0 END]) AS kept FROM events""")
def scalars(spark, sf):
    """Of a JSON record the allowed names alone: finite numbers from 0 on, and real truth values, not words for them."""
    v = F.col("value")
    yes = F.when(_mod("event_id", 2, 0), "true").when(_mod("event_id", 3, 0), '"true"').otherwise("false")
    record = F.concat(F.lit('{"value":'), v.cast("string"), F.lit(',"delta":'), (v - 20).cast("string"), F.lit(',"first":'), yes, F.lit(',"name":"'), F.col("event_type"), F.lit('"}'))
    allowed = {"value": "double", "delta": "double", "first": "boolean"}
    rows = t(spark, sf, "events").select("event_id", F.explode(wf.scalars(record, allowed)).alias("s"))
    return rows.select("event_id", "s.name", F.round("s.kept", 6).alias("kept"))


@query("d3_zone_present", """WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ['+00:00', 'Z', '', ' UTC', '-05:30', '+5'][(event_id % 6 + 1)::INT] AS s FROM events) SELECT event_id, regexp_matches(s, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') AS zoned FROM s""")
def zoned(spark, sf):
    zone = F.element_at(F.array(*map(F.lit, ["+00:00", "Z", "", " UTC", "-05:30", "+5"])), (F.col("event_id") % 6 + 1).cast("int"))
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return t(spark, sf, "events").select("event_id", s.rlike(r"(Z|[+-]\d{2}:\d{2})$").alias("zoned"))


@query("a16_multi_case_summary", """WITH v AS (SELECT o_orderpriority, unnest(list_filter([CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL)) AS rule FROM orders),
c AS (SELECT o_orderpriority, rule, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT o_orderpriority, string_agg(rule || '=' || n, ',' ORDER BY rule) AS findings FROM c GROUP BY 1)
SELECT o.o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, round(sum(o_totalprice), 2) AS total, max(findings) AS findings FROM orders o LEFT JOIN f ON f.o_orderpriority = o.o_orderpriority GROUP BY 1""")
def multi_case(spark, sf):
    o = t(spark, sf, "orders")
    rules = {"cheap": F.col("o_totalprice") >= 50000, "pending": F.col("o_orderstatus") != "P"}
    n = co.violations(o, rules, ["o_orderpriority"]).groupBy("o_orderpriority", "rule").agg(F.count("*").alias("n"))
    told = n.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "n"))), lambda x: F.concat_ws("=", x["rule"], x["n"].cast("string"))), ",").alias("findings"))
    by = o.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return by.join(told, "o_orderpriority", "left")


@query("x20_selection_faults", """WITH s AS (SELECT o_custkey, o_orderkey % 700 AS item FROM orders), c AS (SELECT p_partkey AS item FROM part WHERE p_partkey % 9 <> 0),
g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT s.item) AS d, count(*) FILTER (c.item IS NULL) AS u FROM s LEFT JOIN c USING (item) GROUP BY 1)
SELECT o_custkey, unnest(list_filter([CASE WHEN u > 0 THEN 'unknown' END, CASE WHEN n > d THEN 'repeated' END, CASE WHEN n > 3 THEN 'too_many' END], lambda x: x IS NOT NULL)) AS fault FROM g""")
def selection_faults(spark, sf):
    chosen = t(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 700).alias("item"))
    return au.selection_faults(chosen, t(spark, sf, "part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("item")), "o_custkey", "item")


@query("x21_verdict_faults", """WITH v AS (SELECT conv_id, conv_id % 2 = 0 AS supported, CASE WHEN conv_id % 3 = 0 THEN [] WHEN conv_id % 7 = 1 THEN ['abc'] ELSE list(role || turn % 3) END AS q FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(list_filter([CASE WHEN supported AND len(q) = 0 THEN 'support_without_quote' END, CASE WHEN NOT supported AND len(q) > 0 THEN 'quote_without_support' END, CASE WHEN len(list_filter(q, lambda x: length(x) < 4 OR length(x) > 600)) > 0 THEN 'quote_length' END,
 CASE WHEN len(list_distinct(q)) < len(q) THEN 'quote_repeated' END], lambda x: x IS NOT NULL)) AS fault FROM v""")
def verdict_faults(spark, sf):
    v = t(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat("role", (F.col("turn") % 3).cast("string"))).alias("all"))
    quotes = F.when(_mod("conv_id", 3, 0), F.array().cast("array<string>")).when(_mod("conv_id", 7, 1), F.array(F.lit("abc"))).otherwise(F.col("all"))
    return au.verdict_faults(v.select("conv_id", _mod("conv_id", 2, 0).alias("supported"), quotes.alias("quotes")), "conv_id")


@query("v7_x35_classification", """WITH w AS (SELECT user_id, s AS stage FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('view'), ('purchase'), ('signup')) v(s)), f AS (SELECT user_id, event_type AS stage, bool_or(value > 60) AS failed FROM events GROUP BY ALL)
SELECT w.user_id, w.stage, CASE WHEN failed THEN 'FAIL' WHEN failed IS NULL THEN 'SKIPPED' ELSE 'PASS' END AS status FROM w LEFT JOIN f ON f.user_id = w.user_id AND f.stage = w.stage""")
def classification(spark, sf):
    stages = t(spark, sf, "events").select("user_id", F.col("event_type").alias("stage"), (F.col("value") > 60).alias("failed"))
    return au.observed(stages, ["click", "view", "purchase", "signup"], "user_id")


@query("x14_token_budget", BM25_SQL + f""", k AS (SELECT query_id, bm.doc_id, len(string_split(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' ')) + len(string_split(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), ' ')) + 3 AS tokens FROM bm JOIN documents d ON d.doc_id = bm.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
SELECT query_id, doc_id, tokens FROM k WHERE tokens > 512""")
def token_budget(spark, sf):
    """Pairs that a scorer of 512 tokens would have to cut, words counted as tokens."""
    words = lambda c: F.size(F.split(tx.clean(F.col(c)), " "))
    pairs = _bm25(spark, sf, 10).select("query_id", "doc_id").join(_queries(spark, sf), "query_id").join(t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return au.over_budget(pairs, ["query_id", "doc_id"], (words("query") + words("text") + 3).cast("long"))


@query("x17_adapted_candidates", """WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, text, CASE WHEN doc_id % 97 = 8 THEN 'nan'::DOUBLE ELSE (doc_id % 21 - 10)::DOUBLE / 7 END AS score FROM documents),
s AS (SELECT *, place + (doc_id % 61 = 7)::INT AS rank, CASE WHEN doc_id % 53 = 4 THEN 'x' ELSE sha256(text) END AS sha, (score > 0) <> (doc_id % 71 = 6) AS eligible FROM a)
SELECT doc_id, unnest(list_filter([CASE WHEN rank <> place THEN 'order' END, CASE WHEN sha <> sha256(text) THEN 'hash' END, CASE WHEN isnan(score) THEN 'not_finite' END, CASE WHEN eligible <> (score > 0) THEN 'eligibility' END], lambda x: x IS NOT NULL)) AS fault FROM s""")
def adapted(spark, sf):
    docs = t(spark, sf, "documents")
    # ids alone are ranked within a source, which can hold a third of all documents; their texts come by id
    a = rk.top(docs.select("doc_id", "source"), ["source"], [F.asc("doc_id")], None, "place").join(docs.select("doc_id", "text"), "doc_id")
    score = F.when(_mod("doc_id", 97, 8), F.lit(float("nan"))).otherwise((F.col("doc_id") % 21 - 10).cast("double") / 7)
    s = a.withColumn("score", score).withColumn("rank", F.col("place") + _mod("doc_id", 61, 7).cast("int")).withColumn("text_sha", F.when(_mod("doc_id", 53, 4), "x").otherwise(F.sha2("text", 256)))
    return au.adapted_faults(s.withColumn("eligible", (F.col("score") > 0) != _mod("doc_id", 71, 6)), "doc_id")


@query("x33_frozen_difference", """WITH b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 83 = 4 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 79 = 2 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 91 <> 5)
SELECT a.p_partkey, unnest(list_filter([CASE WHEN b.p_partkey IS NULL THEN 'row' END, CASE WHEN b.p_partkey IS NOT NULL AND a.p_brand <> b.p_brand THEN 'p_brand' END, CASE WHEN b.p_partkey IS NOT NULL AND a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END], lambda x: x IS NOT NULL)) AS field FROM part a LEFT JOIN b ON b.p_partkey = a.p_partkey""")
def frozen(spark, sf):
    a = t(spark, sf, "part")
    b = a.filter(~_mod("p_partkey", 91, 5)).withColumn("p_brand", F.when(_mod("p_partkey", 83, 4), "other").otherwise(F.col("p_brand"))).withColumn("p_size", F.when(~_mod("p_partkey", 79, 2), F.col("p_size")))
    return au.frozen_difference(a, b, "p_partkey", ["p_name", "p_brand", "p_size"])


@query("x12_manifest_faults", """WITH m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 3 THEN ' ' ELSE s_name END AS title, CASE WHEN s_suppkey % 7 = 2 THEN 'http://www.who.example/a' ELSE 'https://www.who.example/a' END AS url, CASE WHEN s_suppkey % 5 = 1 THEN 'https://other.example/a' ELSE 'https://www.who.example/d' END AS download_url,
 s_suppkey % 4 AS l, CASE s_suppkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' ELSE 'doc' END AS format FROM supplier)
SELECT id, unnest(list_filter([CASE WHEN trim(title) = '' THEN 'blank_title' END, CASE WHEN url NOT LIKE 'https:%' THEN 'host_url' END, CASE WHEN download_url LIKE '%other%' THEN 'host_download_url' END, CASE WHEN l = 3 THEN 'licence' END, CASE WHEN format = 'doc' THEN 'format' END], lambda x: x IS NOT NULL)) AS fault FROM m""")
def manifest(spark, sf):
    k = F.col("s_suppkey")
    licence = F.when(k % 4 == 0, "https://creativecommons.org/licenses/by/4.0/").when(k % 4 == 1, "http://www.creativecommons.org/licenses/by-sa/3.0/igo").when(k % 4 == 2, "https://creativecommons.org/publicdomain/zero/1.0/").otherwise("https://creativecommons.org/licenses/by-nc/4.0/")
    m = t(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 11 == 3, " ").otherwise(F.col("s_name")).alias("title"), F.when(k % 7 == 2, "http://www.who.example/a").otherwise("https://www.who.example/a").alias("url"),
        F.when(k % 5 == 1, "https://other.example/a").otherwise("https://www.who.example/d").alias("download_url"), F.sha2("s_name", 256).alias("sha256"), licence.alias("license_url"), F.lit("see there").alias("license_evidence"),
        F.lit("a reviewer").alias("reviewed_by"), F.lit("https://www.who.example/terms").alias("terms_url"), F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "txt").otherwise("doc").alias("format"),
    )
    return au.manifest_faults(m, ["www.who.example"])


@query("s8_reviewed_documents", f"""WITH c AS (SELECT doc_id, text, {_CLEAN} AS tidy FROM documents), m AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN translate(substr(tidy, 3, 12), 'aeiout', 'AEIOUT') ELSE 'granted under no terms at all' END AS evidence FROM c),
f AS (SELECT doc_id, CASE WHEN doc_id % 29 = 1 THEN 'no_file' WHEN doc_id % 19 = 3 THEN 'bytes' WHEN NOT contains(lower(tidy), lower(trim(regexp_replace(evidence, '\\s+', ' ', 'g')))) THEN 'evidence' END AS fault, tidy FROM m) SELECT doc_id AS id, CASE WHEN fault IS NULL THEN md5(tidy) END AS text, fault FROM f""")
def reviewed(spark, sf):
    d = t(spark, sf, "documents")
    evidence = F.when(_mod("doc_id", 2, 0), F.translate(F.substring(tx.clean(F.col("text")), 3, 12), "aeiout", "AEIOUT")).otherwise("granted under no terms at all")
    m = d.select(F.col("doc_id").alias("id"), F.when(_mod("doc_id", 19, 3), "0").otherwise(F.sha2("text", 256)).alias("sha256"), evidence.alias("license_evidence"))
    return au.reviewed_documents(m, d.filter(~_mod("doc_id", 29, 1)).select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))).select("id", F.md5("text").alias("text"), "fault")


@query("x23_duplicate_evidence", "SELECT l_orderkey, l_returnflag, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_evidence(spark, sf):
    return au.duplicate_evidence(t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_suppkey")


@query("x24_assessment_faults", """WITH a AS (SELECT user_id, event_type, ['no_issue_identified', 'issue_identified', 'uncertain', 'other'][(user_id % 4 + 1)::INT] AS result, count(*) FILTER (value > 40) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN result = 'no_issue_identified' AND n > 0 THEN 'clean_with_findings' WHEN result = 'issue_identified' AND n = 0 THEN 'issue_without_finding' WHEN n > 20 THEN 'too_many' WHEN result = 'other' THEN 'unknown_result' END AS fault FROM a WHERE fault IS NOT NULL""")
def assessments(spark, sf):
    result = F.element_at(F.array(*map(F.lit, ["no_issue_identified", "issue_identified", "uncertain", "other"])), (F.col("user_id") % 4 + 1).cast("int"))
    a = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.when(F.col("value") > 40, F.col("event_id").cast("string"))).alias("findings")).withColumn("result", result)
    return au.assessment_faults(a, ["user_id", "event_type"])


@query("x10_provenance_faults", """WITH r AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 41 = 3 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 37 <> 2), f AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS sha FROM documents WHERE doc_id % 31 <> 5)
SELECT coalesce(f.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'no_record' WHEN f.path IS NULL THEN 'no_file' ELSE 'changed' END AS fault FROM f FULL JOIN r ON f.path = r.path WHERE f.path IS NULL OR r.path IS NULL OR f.sha <> r.sha""")
def provenance(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    recorded = d.filter(~_mod("doc_id", 37, 2)).withColumn("sha256", F.when(_mod("doc_id", 41, 3), "x").otherwise(F.col("sha256")))
    return au.provenance_faults(d.filter(~_mod("doc_id", 31, 5)), recorded)


@query("x7_evidence_round_trip", "SELECT source, doc_id, NOT (doc_id % 17 = 5 OR doc_id % 19 = 6 OR doc_id % 23 = 7) AS holds FROM documents")
def evidence_round_trip(spark, sf):
    """Evidence against what its metadata rebuilds: some texts, scores and ids were changed after the metadata was written."""
    d = t(spark, sf, "documents").withColumn("score", F.col("n_chars") / 7)
    told = F.to_json(F.struct(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("sha"), "score"))
    d = d.withColumn("metadata", F.when(_mod("doc_id", 23, 7), F.lit("{}")).otherwise(told))
    d = d.withColumn("text", F.when(_mod("doc_id", 17, 5), F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("score", F.when(_mod("doc_id", 19, 6), F.col("score") + 1).otherwise(F.col("score")))
    return au.round_trip(d, ["source", "doc_id"], "text", "score", "metadata")


@query("r9_envelope_text", """WITH g AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole, conv_id % 6 AS k FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN k = 0 AND trim(whole) <> '' THEN md5(whole) END AS text, CASE k WHEN 1 THEN 'incomplete_output' WHEN 2 THEN 'refusal' WHEN 0 THEN CASE WHEN trim(whole) = '' THEN 'provider_failure' END ELSE 'provider_failure' END AS failure FROM g""")
def envelopes(spark, sf):
    """Answers in typed envelopes: whole ones, incomplete ones, refusals, other roles, failed ones, and empty ones."""
    k = F.col("conv_id") % 6
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.struct(F.lit("output_text").alias("type"), s["text"].alias("text")))
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    content = F.when(k == 2, F.transform("p", lambda p: F.struct(F.lit("refusal").alias("type"), p["text"].alias("text")))).when(k == 5, F.transform("p", lambda p: F.struct(p["type"].alias("type"), F.lit(" ").alias("text")))).otherwise(F.col("p"))
    item = F.struct(F.lit("message").alias("type"), F.when(k == 3, "user").otherwise("assistant").alias("role"), F.lit("completed").alias("status"), content.alias("content"))
    thought = F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("status"), F.slice("p", 1, 0).alias("content"))
    envelope = F.to_json(F.struct(F.when(k == 1, "incomplete").otherwise("completed").alias("status"), F.when(k == 4, "timeout").alias("error"), F.array(thought, item).alias("output")))
    text, failure = au.envelope_text(envelope)
    return c.select("conv_id", F.md5(text).alias("text"), failure.alias("failure"))


_QUOTES = """qt AS (SELECT doc_id, unnest([substr(text, 11, 15), substr(text, 21, 15), CASE WHEN doc_id % 3 = 0 THEN substr(text, 61, 20) ELSE 'not to be found there' END]) AS quote FROM documents WHERE length(text) >= 80)"""


def _quotes(spark, sf):
    x = F.col("text")
    third = F.when(_mod("doc_id", 3, 0), x.substr(61, 20)).otherwise("not to be found there")
    return t(spark, sf, "documents").filter(F.length("text") >= 80).select("doc_id", F.explode(F.array(x.substr(11, 15), x.substr(21, 15), third)).alias("quote"))


@query("x18_quoted_spans", f"""WITH {_QUOTES}, p AS (SELECT doc_id, strpos(text, quote) - 1 AS start, strpos(text, quote) - 1 + length(quote) AS "end" FROM qt JOIN documents USING (doc_id) WHERE strpos(text, quote) > 0),
g AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g), s AS (SELECT doc_id, min(start)::INT AS start, max("end")::INT AS "end" FROM i GROUP BY doc_id, island)
SELECT doc_id, start, "end", substr(text, start + 1, "end" - start) AS text, doc_id || ':' || sha256(documents.text) || ':' || start || '-' || "end" AS chunk_id FROM s JOIN documents USING (doc_id)""")
def quoted(spark, sf):
    return ev.quoted_spans(_quotes(spark, sf), t(spark, sf, "documents"), "doc_id")


@query("x32_missing_quotes", f"WITH {_QUOTES} SELECT doc_id, quote FROM qt JOIN documents USING (doc_id) WHERE strpos(text, quote) = 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, quote FROM qt WHERE doc_id % 5 = 0")
def missing(spark, sf):
    """Quotes that no source answers for: those not in their text, and all of texts that are gone."""
    return ev.missing_quotes(_quotes(spark, sf), t(spark, sf, "documents").filter("doc_id % 5 <> 0"), "doc_id")


@query("x5_signature_guard", "SELECT vec_id % 4 AS part, vec_id % 4 <> 3 AS searchable, count(*) AS n FROM embeddings GROUP BY ALL")
def signature_guard(spark, sf):
    """Parts of a collection that a model may search: those stored under its signature."""
    from siftstone.operators.models import HashingEmbedder

    model = HashingEmbedder(64)
    v = t(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("part"), F.when(F.col("vec_id") % 4 == 3, "other-v2:64").otherwise(model.signature).alias("signature"))
    return v.groupBy("part").agg(F.min(F.col("signature") == model.signature).alias("searchable"), F.count("*").alias("n"))

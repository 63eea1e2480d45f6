"""Judged pools over benchmark queries, reviews of selections, verified selections, role inputs and unit windows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftstone.operators import judging as ju
from siftstone.operators import packing as pk
from siftstone.operators import ranking as rk
from siftstone.plans.base import query, t
from siftstone.plans.retrieval import BM25_SQL, _bm25

# The pool of a benchmark query is its ranking. Of every five pools one has no judgment, one lacks every third, one has all and none uncertain.
_POOL_SQL = BM25_SQL + """, lab AS (SELECT query_id AS pool_id, bm.doc_id AS candidate_id, rank, CASE WHEN query_id % 5 = 0 OR (query_id % 5 = 1 AND bm.doc_id % 3 = 0) THEN NULL
 WHEN l.doc_id IS NULL THEN CASE WHEN query_id % 5 = 2 THEN 'not_relevant' ELSE 'uncertain' END WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 1 THEN 'partially_relevant' ELSE 'not_relevant' END AS rel
 FROM bm LEFT JOIN labels l ON l.doc_id = bm.doc_id)"""


def _pool(spark, sf):
    told = t(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("there"))
    met = _bm25(spark, sf).select("query_id", "doc_id", "rank").join(told, "doc_id", "left")
    p, good = F.col("query_id") % 5, F.col("quality") == 1
    unlabelled = F.when(p == 2, "not_relevant").otherwise("uncertain")
    rel = F.when((p == 0) | ((p == 1) & (F.col("doc_id") % 3 == 0)), F.lit(None)).when(F.col("there").isNull(), unlabelled).when(good & (F.col("toxic") == 0), "relevant").when(good, "partially_relevant").otherwise("not_relevant")
    return met.select(F.col("query_id").alias("pool_id"), F.col("doc_id").alias("candidate_id"), "rank", rel.alias("relevance"))


@query("a15_review_status", _POOL_SQL + """ SELECT *, CASE WHEN reviewed = 0 THEN 'withheld' WHEN complete THEN 'complete' ELSE 'provisional' END AS status FROM (SELECT *, reviewed = candidates AND uncertain = 0 AS complete FROM (
SELECT pool_id, count(*) AS candidates, count(rel) AS reviewed, count(*) FILTER (rel = 'relevant') AS relevant, count(*) FILTER (rel = 'partially_relevant') AS partially_relevant, count(*) FILTER (rel = 'not_relevant') AS not_relevant, count(*) FILTER (rel = 'uncertain') AS uncertain FROM lab GROUP BY pool_id))""")
def review_status(spark, sf):
    return ju.review_status(_pool(spark, sf))


@query("a15_pool_metrics", _POOL_SQL + """, sys AS (SELECT pool_id, candidate_id, 'bm25' AS system, rank FROM lab UNION ALL SELECT * FROM (SELECT pool_id, candidate_id, 'newest', row_number() OVER (PARTITION BY pool_id ORDER BY candidate_id DESC) AS n FROM lab) WHERE n <= 5),
j AS (SELECT pool_id, candidate_id, mode, coalesce(list_contains(ok, rel), false) AS pos FROM lab, (VALUES ('strict', ['relevant']), ('inclusive', ['relevant', 'partially_relevant'])) m(mode, ok)),
tot AS (SELECT pool_id, mode, count(*) FILTER (pos) AS positives FROM j WHERE pool_id IN (SELECT pool_id FROM lab WHERE rel IS NOT NULL) GROUP BY ALL),
x AS (SELECT tot.pool_id, tot.mode, d.system, d.depth, positives, coalesce(list(s.rank) FILTER (pos), []) AS ranks FROM tot CROSS JOIN (VALUES ('bm25', 50), ('newest', 5)) d(system, depth) LEFT JOIN sys s ON s.pool_id = tot.pool_id AND s.system = d.system
 LEFT JOIN j ON j.pool_id = tot.pool_id AND j.mode = tot.mode AND j.candidate_id = s.candidate_id GROUP BY ALL)
SELECT pool_id, mode, system, k, least(k, depth) AS cutoff, positives, CASE WHEN positives > 0 THEN round(len(list_filter(ranks, lambda r: r <= least(k, depth)))::DOUBLE / positives, 9) END AS recall,
 CASE WHEN positives > 0 THEN coalesce(round(1.0::DOUBLE / list_min(ranks), 9), 0.0) END AS mrr FROM x, (VALUES (5), (10), (20), (50)) v(k)""")
def pool_metrics(spark, sf):
    """Two systems over one pool: a ranking captured to 50, and one that gives five and no more."""
    pool = _pool(spark, sf)
    newest = rk.top(pool.select("pool_id", "candidate_id"), ["pool_id"], [F.desc("candidate_id")], 5)
    rankings = pool.select("pool_id", "candidate_id", F.lit("bm25").alias("system"), "rank").unionByName(newest.select("pool_id", "candidate_id", F.lit("newest").alias("system"), "rank"))
    systems = pool.select("pool_id").distinct().select("pool_id", F.inline(F.array(F.struct(F.lit("bm25").alias("system"), F.lit(50).alias("depth")), F.struct(F.lit("newest").alias("system"), F.lit(5).alias("depth")))))
    return ju.pool_metrics(pool, rankings, systems)


@query("w10_topic_ranks", BM25_SQL + """, r AS (SELECT query_id, rank, score, lower(string_split(text, chr(10))[1]) AS title FROM bm JOIN documents USING (doc_id))
SELECT query_id, depth, count(*) AS returned, count(*) FILTER (score > 8) AS retained, array_to_string(list_sort(coalesce(list(rank) FILTER (contains(title, 'tion')), [])), ',') AS tion, array_to_string(list_sort(coalesce(list(rank) FILTER (contains(title, 'the')), [])), ',') AS the
FROM r, (VALUES (5), (10), (20), (50)) v(depth) WHERE rank <= depth GROUP BY ALL""")
def topic_ranks(spark, sf):
    """Where two topics stand among the titles of a query's first 5, 10, 20 and 50, and how many pass a gate there."""
    titles = t(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"))
    swept = ju.depth_topics(_bm25(spark, sf).join(titles, "doc_id"), ["query_id"], "title", ["tion", "The"], F.col("score") > 8)
    shown = lambda x: F.array_join(F.col("topic_ranks")[x].cast("array<string>"), ",")
    return swept.select("query_id", "depth", "returned", "retained", shown("tion").alias("tion"), shown("The").alias("the"))


# An analysis of every document under two roles, and reviews of it. Of the reviews every 29th speaks of a pair that is not eligible, every 31st has an unknown
# kind, every 37th another score, every 41st another query, every 43rd another text, every 47th a pair that was never analysed.
_REVIEW_SQL = """WITH a AS (SELECT doc_id % 4 AS pool_id, doc_id AS candidate_id, role, r, sha256(text) AS sha, (doc_id * 7 + r * 3) % 17 - 5 AS s, (doc_id * 5 + r) % 17 - 8 AS before, role || ':' || doc_id % 9 AS query FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), (VALUES ('symptoms', 0), ('history', 1)) v(role, r)),
b AS (SELECT *, s > 0 AND candidate_id % 3 = 0 AS selected, s > 0 AND candidate_id % 2 = 0 AS counterfactual, CASE WHEN s <= 0 THEN 'weak' WHEN candidate_id % 5 < 2 THEN 'cap' ELSE 'duplicate' END AS rule FROM a),
v AS (SELECT *, before <= 0 AND (s > 0 OR candidate_id % 29 = 0) AS newly, candidate_id % 29 = 0 AND s <= 0 AS f_eligible, candidate_id % 31 = 0 AS f_kind, candidate_id % 37 = 0 AS f_score, candidate_id % 41 = 0 AS f_query, candidate_id % 43 = 0 AS f_sha, candidate_id % 47 = 0 AS f_pair,
 ['A', 'B', 'C'][(candidate_id // 3) % 3 + 1] AS kind FROM b)"""


def _analysis(spark, sf):
    roles = F.array(F.struct(F.lit("symptoms").alias("role"), F.lit(0).alias("r")), F.struct(F.lit("history").alias("role"), F.lit(1).alias("r")))
    d, s = F.col("doc_id"), F.col("s")
    each = t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.inline(roles))
    each = each.withColumn("s", (d * 7 + F.col("r") * 3) % 17 - 5).withColumn("before", (d * 5 + F.col("r")) % 17 - 8)
    why = F.when(s <= 0, "weak").when(d % 5 < 2, "cap").otherwise("duplicate")
    return each.select(
        (d % 4).alias("pool_id"), d.alias("candidate_id"), "role", "before", (s > 0).alias("eligible"), (s / 8).alias("score"), F.concat("role", F.lit(":"), (d % 9).cast("string")).alias("query"), "sha",
        ((s > 0) & (d % 3 == 0)).alias("selected"), ((s > 0) & (d % 2 == 0)).alias("counterfactual"), why.alias("rule"), why.alias("counterfactual_rule"),
    )


def _reviews(analysis, faults: bool):
    d, planted = F.col("candidate_id"), lambda n, wrong, right: F.when((F.col("candidate_id") % n == 0) & F.lit(faults), wrong).otherwise(right)
    newly = (F.col("before") <= 0) & (F.col("eligible") | ((d % 29 == 0) & F.lit(faults)))
    kind = F.element_at(F.array(*map(F.lit, ju.KINDS)), (F.floor(d / 3) % 3 + 1).cast("int"))
    return analysis.select(
        "pool_id", planted(47, -d - 1, d).alias("candidate_id"), "role", planted(31, F.lit("D"), kind).alias("kind"), planted(37, F.col("score") + 0.125, F.col("score")).alias("score"), planted(41, F.concat("query", F.lit("!")), F.col("query")).alias("query"),
        planted(43, F.sha2("sha", 256), F.col("sha")).alias("sha"), F.when(newly, ju.NEWLY).otherwise("other").alias("transition"),
    )


@query("j13_review_faults", _REVIEW_SQL + """ SELECT pool_id, CASE WHEN f_pair THEN -candidate_id - 1 ELSE candidate_id END AS candidate_id, role, unnest(list_filter([CASE WHEN f_pair THEN 'unknown_pair' END, CASE WHEN f_kind THEN 'kind' END, CASE WHEN f_eligible AND NOT f_pair THEN 'not_eligible' END, CASE WHEN f_score AND NOT f_pair THEN 'score' END,
 CASE WHEN f_query AND NOT f_pair THEN 'query' END, CASE WHEN f_sha AND NOT f_pair THEN 'sha' END], lambda x: x IS NOT NULL)) AS rule FROM v WHERE newly""")
def review_faults(spark, sf):
    a = _analysis(spark, sf)
    return ju.review_faults(a, _reviews(a, True))


@query("j13_kind_counts", _REVIEW_SQL + """, n AS (SELECT * FROM v WHERE before <= 0 AND s > 0), c AS (SELECT pool_id, kind, 'selection' AS w, rule, count(*) AS n FROM n WHERE NOT selected GROUP BY ALL UNION ALL SELECT pool_id, kind, 'counterfactual', rule, count(*) FROM n WHERE NOT counterfactual GROUP BY ALL),
t AS (SELECT pool_id, kind, string_agg(rule || '=' || n, ',' ORDER BY rule) FILTER (w = 'selection') AS rejected, string_agg(rule || '=' || n, ',' ORDER BY rule) FILTER (w = 'counterfactual') AS counterfactual_rejected FROM c GROUP BY ALL),
k AS (SELECT pool_id, kind, count(*) AS pairs, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS not_selected, count(*) FILTER (counterfactual) AS counterfactual, count(*) FILTER (counterfactual AND NOT selected) AS newly FROM n GROUP BY ALL)
SELECT pool_id, kind, coalesce(pairs, 0) AS pairs, coalesce(selected, 0) AS selected, coalesce(not_selected, 0) AS not_selected, coalesce(counterfactual, 0) AS counterfactual, coalesce(newly, 0) AS newly, coalesce(rejected, '') AS rejected, coalesce(counterfactual_rejected, '') AS counterfactual_rejected
FROM (SELECT DISTINCT pool_id FROM n) CROSS JOIN (VALUES ('A'), ('B'), ('C')) w(kind) LEFT JOIN k USING (pool_id, kind) LEFT JOIN t USING (pool_id, kind)""")
def kind_counts(spark, sf):
    a = _analysis(spark, sf)
    told = ju.kind_counts(ju.reviewed_pairs(a, _reviews(a, False)))
    shown = lambda x: F.coalesce(F.array_join(F.transform(F.map_entries(F.col("rejections")[x]), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))
    return told.select("pool_id", "kind", "pairs", "selected", "not_selected", "counterfactual", "newly", shown("selection").alias("rejected"), shown("counterfactual").alias("counterfactual_rejected"))


# A selector proposes the first three of a query's ranking. Of every eleven cases one has no proposal, one a repeated id, one an unknown one, one four
# of them, one reviews that confirm nothing. Some reviews fail, some quote half a fact, some quote a header line.
_CASES_SQL = BM25_SQL + """, p AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM bm WHERE rank <= 4 GROUP BY query_id),
pr AS (SELECT item_id AS c, text AS q, CASE item_id % 11 WHEN 0 THEN NULL WHEN 1 THEN list_append(l[1:2], l[1]) WHEN 2 THEN list_prepend(-1, l[2:3]) WHEN 3 THEN l ELSE l[1:3] END AS ids FROM p JOIN benchmark ON item_id = query_id),
r AS (SELECT c, ids, nth, id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN (c + id) % 13 = 0 THEN 'failed' WHEN (c + id) % 17 = 0 OR (c + id) % 19 = 0 THEN 'unsupported' WHEN c % 11 <> 4 AND (id % 2 = 0 OR c % 5 = 0) THEN 'relevant' ELSE 'not_relevant' END AS o
 FROM (SELECT c, ids, unnest(ids) AS id, generate_subscripts(ids, 1) AS nth FROM pr WHERE ids IS NOT NULL) LEFT JOIN documents d ON d.doc_id = id),
sm AS (SELECT c, count(*) AS n, count(DISTINCT id) AS m, bool_or(o = 'unknown') AS unknown, min(nth) FILTER (o IN ('failed', 'unsupported')) AS bad, arg_min(o, nth) FILTER (o IN ('failed', 'unsupported')) AS how, coalesce(list(id ORDER BY nth) FILTER (o = 'relevant'), []) AS chosen FROM r GROUP BY c),
z AS (SELECT pr.c AS case_id, CASE WHEN ids IS NULL THEN 'selector_failure' WHEN n > 3 OR m < n OR unknown THEN 'invalid_selection' WHEN how = 'failed' THEN 'content_review_failure' WHEN how = 'unsupported' THEN 'content_contract_failure' WHEN len(chosen) > 0 THEN 'selected_and_verified' ELSE 'no_selection' END AS status, chosen, n, bad FROM pr LEFT JOIN sm ON sm.c = pr.c)"""


@query("t15_verified_selection", _CASES_SQL + """ SELECT case_id, status, CASE WHEN status = 'selected_and_verified' THEN array_to_string(chosen, ',') ELSE '' END AS selected, CASE WHEN status IN ('selector_failure', 'invalid_selection') THEN 0 ELSE coalesce(bad, n) END AS reviewed FROM z""")
def verified_selection(spark, sf):
    c, q, at = F.col("case_id"), F.col("query"), F.col("case_id") % 11
    ranked = _bm25(spark, sf, 4).groupBy(F.col("query_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("l"))
    cases = ranked.join(t(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query")), "case_id")
    first = F.slice("l", 1, 1)
    ids = F.when(at == 0, F.lit(None)).when(at == 1, F.concat(F.slice("l", 1, 2), first)).when(at == 2, F.concat(F.array(F.lit(-1).cast("long")), F.slice("l", 2, 2))).when(at == 3, F.col("l")).otherwise(F.slice("l", 1, 3))
    catalog = t(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Topic: w\nTitle: \x01t\nURL: u\nType: x\n"), "text").alias("text"))
    fact = F.concat(F.lit("q"), c.cast("string"), F.lit(" = "), F.substring("query", 1, 10))
    facts = cases.select("case_id", F.array(fact).alias("rendered"), F.array("query").alias("literals"))
    d = F.col("document_id")
    n = c + d
    asked = cases.select("case_id", "query", F.explode(F.array_distinct("l")).alias("document_id")).join(catalog.select("document_id", F.col("text").alias("body")), "document_id")
    quoted = F.when(n % 17 == 0, F.concat(F.lit("q"), c.cast("string"), F.lit(" ="))).when(d % 4 == 1, F.substring("query", 3, 8)).otherwise(fact)
    responses = asked.select(
        "case_id", "document_id", F.when(n % 13 == 0, F.lit(None)).when((at != 4) & ((d % 2 == 0) | (c % 5 == 0)), "relevant").otherwise("not_relevant").alias("verdict"), F.array(quoted).alias("fact_quotes"),
        F.array(F.when(n % 19 == 0, "Title: \x01t").otherwise(F.substring(F.substring_index("body", "\nType: x\n", -1), 2, 12))).alias("content_quotes"),
    )
    told = ju.verified_selection(cases.select("case_id", ids.alias("ids")), responses, catalog, facts)
    return told.select("case_id", "status", F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"), "reviewed")


# Queries of two roles whose facts are the first words of a benchmark text. Every seventh has no fact, every ninth five, every eleventh one of the other role, every thirteenth another population.
_ROLE_SQL = """WITH q AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 2 = 0 THEN 'symptoms' ELSE 'history' END AS role, CASE WHEN item_id % 6 < 5 THEN item_id * 11 % 90 END AS age, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w,
 CASE WHEN item_id % 7 = 0 THEN 0 WHEN item_id % 9 = 0 THEN 5 ELSE 1 + item_id % 4 END AS n FROM benchmark), p AS (SELECT *, CASE WHEN age IS NULL THEN '' WHEN age < 18 THEN 'child' WHEN age >= 65 THEN 'older adult' ELSE 'adult' END AS people, w[1:n] AS f FROM q)"""


def _role_queries(spark, sf, faults: bool):
    k, age = F.col("item_id"), F.col("age")
    role = F.when(k % 2 == 0, "symptoms").otherwise("history")
    n = F.when((k % 7 == 0) & F.lit(faults), 0).when((k % 9 == 0) & F.lit(faults), 5).otherwise((1 + k % 4).cast("int"))
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.lit(1), n)
    other = F.when((k % 11 == 0) & F.lit(faults), F.when(F.col("role") == "symptoms", "history").otherwise("symptoms")).otherwise(F.col("role"))
    people = F.when((k % 13 == 0) & F.lit(faults), "nobody").when(age.isNull(), "").when(age < 18, "child").when(age >= 65, "older adult").otherwise("adult")
    b = t(spark, sf, "benchmark").withColumn("role", role).withColumn("age", F.when(k % 6 < 5, k * 11 % 90)).withColumn("kind", other).withColumn("words", words)
    return b.select(k.alias("query_id"), "role", "text", F.transform("words", lambda w: F.struct(F.col("kind").alias("kind"), w.alias("text"))).alias("facts"), "age", people.alias("population"))


@query("f25_input_faults", _ROLE_SQL + """ SELECT query_id, unnest(list_filter([CASE WHEN len(f) NOT BETWEEN 1 AND 4 THEN 'facts' END, CASE WHEN query_id % 11 = 0 AND len(f) > 0 THEN 'kind' END, CASE WHEN query_id % 13 = 0 THEN 'population' END], lambda x: x IS NOT NULL)) AS rule FROM p""")
def input_faults(spark, sf):
    return ju.input_faults(_role_queries(spark, sf, True))


@query("f25_reranker_inputs", _ROLE_SQL.replace("CASE WHEN item_id % 7 = 0 THEN 0 WHEN item_id % 9 = 0 THEN 5 ELSE 1 + item_id % 4 END", "1 + item_id % 4") + f""", g AS (SELECT *, CASE WHEN len(f) = 1 THEN f[1] ELSE array_to_string(f[1:len(f) - 1], ', ') || ' and ' || f[len(f)] END AS named FROM p)
SELECT query_id, role, variant, CASE variant WHEN 'original' THEN text WHEN 'prefix_only' THEN CASE role WHEN 'symptoms' THEN '{ju.PREFIXES["symptoms"]}' ELSE '{ju.PREFIXES["history"]}' END || text
 ELSE CASE role WHEN 'symptoms' THEN replace('{ju.CURRENT.replace("'", "''")}', '%s', named) ELSE replace(replace('{ju.BACKGROUND}', 'information%s', 'information' || CASE people WHEN '' THEN '' WHEN 'child' THEN ' for a child' ELSE ' for an ' || people END), '%s', named) END END AS text FROM g, (VALUES ('original'), ('role_explicit'), ('prefix_only')) v(variant)""")
def reranker_inputs(spark, sf):
    return ju.reranker_inputs(_role_queries(spark, sf, False))


_WORD = re.compile(r"[^ \t\n\r\f]+")


@query("f17_unit_windows", r"""WITH RECURSIVE u AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda b: string_split_regex(regexp_replace(b, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS l FROM documents),
n AS (SELECT doc_id, l, list_transform(l, lambda x: 3 + len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))) AS c FROM u WHERE len(l) > 0),
w AS (SELECT doc_id, c, 1 AS i, c[1]::BIGINT AS used, 0 AS win FROM n WHERE list_max(c) <= 40 UNION ALL SELECT doc_id, c, i + 1, CASE WHEN used + c[i + 1] - 3 <= 40 THEN used + c[i + 1] - 3 ELSE c[i + 1] END, CASE WHEN used + c[i + 1] - 3 <= 40 THEN win ELSE win + 1 END FROM w WHERE i < len(c)),
g AS (SELECT w.doc_id, win, string_agg(l[i], chr(10) ORDER BY i) AS x, max(used) AS m FROM w JOIN n ON n.doc_id = w.doc_id GROUP BY ALL)
SELECT doc_id, count(*) AS windows, 0 AS over, max(m)::INT AS most, md5(string_agg(x, chr(2) ORDER BY win)) AS digest FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 0, len(list_filter(c, lambda x: x > 40)), list_max(c)::INT, NULL FROM n WHERE list_max(c) > 40""")
def unit_windows(spark, sf):
    """Documents as windows of whole sentences and lines, 40 words at most with a header of three; a document with a longer unit has none."""
    docs = t(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("Topic "), F.col("doc_id").cast("string"), F.lit(" / Overview")).alias("header"))
    docs = docs.withColumn("header", F.regexp_replace("header", " / ", "/ "))
    w = pk.unit_windows(docs, "doc_id", "text", "header", lambda x: len(_WORD.findall(x)), 40)
    at = F.sort_array(F.collect_list(F.when(F.col("window").isNotNull(), F.struct("window", "text"))))
    by = w.groupBy("doc_id").agg(F.count("window").alias("windows"), F.count_if(F.col("window").isNull()).alias("over"), F.max("tokens").alias("most"), at.alias("w"))
    return by.select("doc_id", "windows", "over", "most", F.when(F.col("over") == 0, F.md5(F.array_join(F.transform("w", lambda x: x["text"]), "\x02"))).alias("digest"))


# Each conversation as a diagnosis over its turns: user turns are what is known of the patient, every third turn is medical knowledge.
@query("r3_claim_links", """WITH c AS (SELECT conv_id AS k, turn, 't' || turn AS r, role FROM conversations), g AS (SELECT k, list(r ORDER BY turn) AS refs, coalesce(list(r ORDER BY turn) FILTER (role = 'user'), []) AS facts, coalesce(list(r ORDER BY turn) FILTER (turn % 3 = 2), []) AS know FROM c GROUP BY k),
x AS (SELECT *, '/primary_hypothesis' AS h, '/primary_hypothesis/rationale' AS path, refs[1:1] AS cited FROM g WHERE k % 4 > 0 UNION ALL SELECT g.*, '/primary_hypothesis', '/primary_hypothesis/supporting_evidence/' || (i - 1), refs[i:i + 1] FROM g, (VALUES (1), (2)) v(i) WHERE k % 4 > 0
UNION ALL SELECT *, '/differential_diagnoses/0', '/differential_diagnoses/0/rationale', ['zz'] FROM g UNION ALL SELECT *, '/differential_diagnoses/0', '/differential_diagnoses/0/contradicting_evidence/0', refs[1:k % 4] FROM g UNION ALL SELECT *, NULL, '/treatment/actions/0/proposal', refs FROM g WHERE k % 3 = 0),
y AS (SELECT *, list_sort(list_filter(list_distinct(cited), lambda r: list_contains(facts, r))) AS p, list_sort(list_filter(list_distinct(cited), lambda r: list_contains(know, r))) AS m FROM x)
SELECT k AS case_id, path, array_to_string(p, ',') AS patient, array_to_string(m, ',') AS medical, len(m) > 0 AS supported, h IS NOT NULL AND max(len(m)) OVER (PARTITION BY k, h) = 0 AS bare FROM y""")
def claim_links(spark, sf):
    """Every claim of a nested diagnosis by its path, with the references that stand behind it, and hypotheses that no knowledge backs."""
    from siftstone.operators import evaluation as em

    turns = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("r"))))), lambda x: x["r"])
    g = t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(turns(F.lit(True)).alias("refs"), turns(F.col("role") == "user").alias("facts"), turns(F.col("turn") % 3 == 2).alias("knowledge"))
    k, claim = F.col("case_id"), lambda x: F.struct(x.alias("refs"))
    part = lambda a, n: F.slice("refs", F.lit(a), n)
    none = F.array().cast("array<struct<refs:array<string>>>")
    hyp = lambda rationale, supporting, contradicting: F.struct(claim(rationale).alias("rationale"), supporting.alias("supporting"), contradicting.alias("contradicting"))
    primary = F.when(k % 4 > 0, hyp(part(1, F.lit(1)), F.array(claim(part(1, F.lit(2))), claim(part(2, F.lit(2)))), none))
    other = hyp(F.array(F.lit("zz")), none, F.array(claim(part(1, (k % 4).cast("int")))))
    diagnosis = F.struct(primary.alias("primary"), F.array(other).alias("differential"), F.when(k % 3 == 0, F.array(claim(F.col("refs")))).alias("treatment"))
    told = em.claim_links(g.withColumn("diagnosis", diagnosis).withColumn("patient_cases", F.array().cast("array<string>")))
    return told.select("case_id", "path", F.array_join("patient", ",").alias("patient"), F.array_join("medical", ",").alias("medical"), "supported", "bare")

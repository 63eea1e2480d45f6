"""Event-sourced workflows over events and conversations, and retrieval evaluation over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import evaluation as em
from siftstone.operators import ranking as rk
from siftstone.operators import workflow as wf
from siftstone.plans.base import query, t
from siftstone.plans.retrieval import BM25_SQL, _bm25

_ALLOWED = {"view": ["click", "view"], "click": ["purchase", "view"], "signup": ["view"], "purchase": ["view"]}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, to in _ALLOWED.items() for b in to)


def _events(spark, sf):
    return t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_illegal_transitions", f"""SELECT user_id, event_id, from_stage, event_type AS to_stage FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage FROM events)
WHERE from_stage IS NOT NULL AND (from_stage = 'error' OR (from_stage, event_type) NOT IN ({_PAIRS}))""")
def illegal(spark, sf):
    return wf.illegal_steps(_events(spark, sf), "user_id", [F.asc("ts"), F.asc("event_id")], "event_type", wf.edges(spark, _ALLOWED), ["error"], None).select("user_id", "event_id", "from_stage", "to_stage")


@query("t2_monotone_sequence", "SELECT conv_id, bool_and(turn = n) AS monotone FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY 1")
def monotone(spark, sf):
    ranked = rk.top(t(spark, sf, "conversations"), ["conv_id"], [F.asc("turn")], None, "n")
    return ranked.groupBy("conv_id").agg(F.min(F.col("turn") == F.col("n") - 1).alias("monotone"))


@query("a18_running_totals", "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf):
    e = _events(spark, sf).withColumn("one", F.lit(1).cast("long"))
    return wf.running(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], requests="one", spent="value").select("event_id", "requests", F.round("spent", 4).alias("spent"))


@query("t3_budget_breach", "SELECT user_id, min(n) FILTER (spent > 200 OR n > 21) AS breach FROM (SELECT user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def breach(spark, sf):
    e = wf.running(_events(spark, sf).withColumn("one", F.lit(1).cast("long")), ["user_id"], [F.asc("ts"), F.asc("event_id")], n="one", spent="value")
    return wf.first_breach(e, ["user_id"], "n", (F.round("spent", 4) > 200) | (F.col("n") > 21))


@query("t4_routing", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'BLOCKED' WHEN event_type = 'signup' THEN 'ABSTENTION' WHEN (event_type = 'error' OR event_id % 3 > 0) AND user_id % 3 >= 2 THEN 'UNRESOLVED'
 WHEN event_type = 'error' OR event_id % 3 > 0 THEN 'DIAGNOSTIC_REVISION' WHEN event_id % 2 = 0 THEN 'ABSTENTION' ELSE 'FINAL' END AS next_stage FROM events""")
def routing(spark, sf):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "insufficient_evidence").when(F.col("event_type") == "error", "revision_required").otherwise("supported_with_limitations")
    told = wf.route((k % 11 == 0).cast("int"), kind, k % 3, k % 2, F.col("user_id") % 3)
    return _events(spark, sf).select("event_id", told["next_stage"].alias("next_stage"))


@query("t5_gated_routing", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_type = 'error' THEN 'safety_blocked' WHEN event_type = 'signup' THEN 'human_review_required' ELSE 'accepted_with_limitations' END AS outcome,
 CASE WHEN event_id % 11 = 0 THEN 'critic_safety_flags' WHEN event_type = 'error' THEN 'safety_block' WHEN event_type = 'signup' THEN 'safety_human_review' ELSE 'critic_supported_with_limitations' END AS reason FROM events""")
def gated(spark, sf):
    flags = (F.col("event_id") % 11 == 0).cast("int")
    decision = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "signup", "HUMAN_REVIEW").otherwise("CONTINUE")
    base = wf.route(F.lit(0), F.lit("supported"), F.lit(0), F.lit(1), F.lit(0))
    told = wf.gated_route(decision, flags, base)
    return _events(spark, sf).select("event_id", told["outcome"].alias("outcome"), told["reason"].alias("reason"))


@query("t6_repeat_detection", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) - 1 AS seen_before FROM events")
def repeat_detection(spark, sf):
    return wf.repeats(_events(spark, sf), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.sha2(F.concat_ws("|", "event_type", "props"), 256)).select("event_id", "seen_before")


@query("t8_j17_staleness", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type AS current FROM events")
def staleness(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf).select("event_id", F.lag("event_type").over(w).eqNullSafe(F.col("event_type")).alias("current"))


@query("a19_t9_safety_fold", """WITH f AS (SELECT user_id, event_type AS code, CASE WHEN event_type = 'error' AND value > 100 THEN 'BLOCK' ELSE 'HUMAN_REVIEW' END AS d FROM events WHERE value > 30)
SELECT u.user_id, CASE WHEN bool_or(d = 'BLOCK') THEN 'BLOCK' WHEN count(d) > 0 THEN 'HUMAN_REVIEW' ELSE 'CONTINUE' END AS decision, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS reasons, count(d) AS n_findings FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id) GROUP BY 1""")
def fold(spark, sf):
    e = _events(spark, sf)
    block = (F.col("event_type") == "error") & (F.col("value") > 100)
    found = e.filter("value > 30").select("user_id", F.col("event_type").alias("code"), F.when(block, "BLOCK").otherwise("HUMAN_REVIEW").alias("disposition"))
    return wf.safety_fold(found, e, "user_id").withColumn("reasons", F.array_join("reasons", ","))


@query("t10_category_coverage", """WITH h AS (SELECT user_id, event_type AS category, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, c FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('view'), ('error')) v(c))
SELECT coalesce(w.user_id, h.user_id) AS user_id, coalesce(c, category) AS category, coalesce(n, 0) AS n FROM w FULL JOIN h ON h.user_id = w.user_id AND h.category = w.c WHERE coalesce(n, 0) <> 1 OR c IS NULL""")
def coverage(spark, sf):
    return wf.coverage_faults(_events(spark, sf).select("user_id", F.col("event_type").alias("category")), "user_id", ["click", "view", "error"])


@query("t11_t12_final_decision", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN 'ALLOW' WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN 'HUMAN_REVIEW' ELSE 'BLOCK' END AS status FROM orders""")
def final(spark, sf):
    k = F.col("o_orderkey")
    flow = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "human_review_required").otherwise("failed")
    return t(spark, sf, "orders").select("o_orderkey", wf.final_decision(flow, k % 7 == 0, k % 2 == 0, F.lit("CONTINUE")).alias("status"))


@query("t13_w20_hash_chain", """SELECT conv_id, turn, sha256(role || '|' || text) AS sha, lag(sha256(role || '|' || text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_sha FROM conversations""")
def hash_chain(spark, sf):
    return wf.chain(t(spark, sf, "conversations"), ["conv_id"], [F.asc("turn")], F.concat_ws("|", "role", "text")).select("conv_id", "turn", "sha", "previous_sha")


@query("w20_chain_faults", """WITH c AS (SELECT conv_id, turn, role, row_number() OVER w AS n, min(turn) OVER (PARTITION BY conv_id) AS f, coalesce(max((role = 'assistant' AND turn = 3)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN turn - f + 1 <> n THEN 'sequence' ELSE 'after_terminal' END AS fault FROM c WHERE turn - f + 1 <> n OR over = 1""")
def chain_faults(spark, sf):
    log = wf.chain(t(spark, sf, "conversations"), ["conv_id"], [F.asc("turn")], F.concat_ws("|", "role", "text"))
    return wf.chain_faults(log, ["conv_id"], "turn", (F.col("role") == "assistant") & (F.col("turn") == 3)).select("conv_id", "turn", "fault")


@query("a17_requests_per_stage", "SELECT user_id, event_type AS stage, count(*) AS requests, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def requests(spark, sf):
    return _events(spark, sf).groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"))


@query("d2_elapsed", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS elapsed_us FROM events")
def elapsed(spark, sf):
    from pyspark.sql.window import Window

    us = F.unix_micros("ts")
    return _events(spark, sf).select("event_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("elapsed_us"))


@query("t16_peak_so_far", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def peak(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf).select("event_id", F.max("value").over(w).alias("peak"))


@query("t15_all_or_nothing", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN 0 ELSE least(3, count(*)) END AS kept FROM events GROUP BY 1")
def all_or_nothing(spark, sf):
    failed = F.max((F.col("event_type") == "error") & (F.col("value") > 150))
    return _events(spark, sf).groupBy("user_id").agg(F.when(failed, F.lit(0)).otherwise(F.least(F.lit(3), F.count("*"))).cast("long").alias("kept"))


# evaluation

_C = "c AS (SELECT doc_id AS candidate_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 1 THEN 'partially_relevant' ELSE 'not_relevant' END AS label, doc_id % 5 <> 0 AS reviewed FROM labels)"
_S = "s AS (SELECT doc_id AS candidate_id, 'by_length' AS system, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT doc_id, 'by_id', row_number() OVER (ORDER BY doc_id) FROM documents)"


def _candidates(spark, sf):
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant").when(F.col("quality") == 1, "partially_relevant").otherwise("not_relevant")
    return t(spark, sf, "labels").select(F.col("doc_id").alias("candidate_id"), label.alias("label"), (F.col("doc_id") % 5 != 0).alias("reviewed"))


def _systems(spark, sf):
    """The first fifty of two total orders: rankings of a stated depth."""
    d = t(spark, sf, "documents")
    a = d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.lit("by_length").alias("system"), "doc_id", "n_chars")
    b = d.orderBy("doc_id").limit(50).select(F.lit("by_id").alias("system"), "doc_id", F.lit(0).cast("long").alias("n_chars"))
    ranked = rk.top(a.unionByName(b), ["system"], [F.desc("n_chars"), F.asc("doc_id")], None)
    return ranked.select(F.col("doc_id").alias("candidate_id"), "system", "rank", F.lit(50).alias("depth"))


def _metrics_sql(labels: str) -> str:
    recalls = ", ".join(f"round(count(*) FILTER (hit AND rank <= {k})::DOUBLE / max(np), 9) AS recall_{k}" for k in em.DEPTHS)
    return f"""WITH {_C}, {_S}, n AS (SELECT count(*) FILTER (reviewed AND label IN ({labels})) AS np FROM c), j AS (SELECT s.system, s.rank, reviewed AND label IN ({labels}) AS hit FROM s JOIN c USING (candidate_id) WHERE s.rank <= 50)
SELECT system, max(np) AS n_positive, {recalls}, coalesce(round(1.0::DOUBLE / min(rank) FILTER (hit), 9), 0.0) AS mrr FROM j, n GROUP BY system"""


@query("a15_recall_mrr_strict", _metrics_sql("'relevant'"))
def strict(spark, sf):
    return em.relevance(_candidates(spark, sf), _systems(spark, sf), "strict")


@query("a15_recall_mrr_inclusive", _metrics_sql("'relevant', 'partially_relevant'"))
def inclusive(spark, sf):
    return em.relevance(_candidates(spark, sf), _systems(spark, sf), "inclusive")


@query("j13_review_join", f"WITH {_C} SELECT doc_id, label FROM documents JOIN c ON candidate_id = doc_id WHERE reviewed")
def review_join(spark, sf):
    c = _candidates(spark, sf).filter("reviewed")
    return t(spark, sf, "documents").join(c, F.col("candidate_id") == F.col("doc_id")).select("doc_id", "label")


@query("j15_aligned_rankings", f"WITH {_S} SELECT candidate_id, min(rank) FILTER (system = 'by_id') AS by_id, min(rank) FILTER (system = 'by_length') AS by_length FROM s WHERE rank <= 50 GROUP BY 1")
def aligned(spark, sf):
    return em.aligned(_systems(spark, sf), "candidate_id", ["by_id", "by_length"])


@query("j16_topic_trace", f"WITH {_C}, {_S} SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT candidate_id FROM c) THEN 'labelled' WHEN doc_id NOT IN (SELECT candidate_id FROM c WHERE reviewed) THEN 'reviewed' WHEN doc_id NOT IN (SELECT candidate_id FROM s WHERE rank <= 50) THEN 'ranked' END AS lost_at FROM documents")
def topic_trace(spark, sf):
    c = _candidates(spark, sf).withColumnRenamed("candidate_id", "doc_id")
    stages = [("labelled", c), ("reviewed", c.filter("reviewed")), ("ranked", _systems(spark, sf).withColumnRenamed("candidate_id", "doc_id"))]
    return em.trace(t(spark, sf, "documents"), stages, "doc_id")


def _runs(spark, sf):
    x = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_suppkey")
    v = F.col("l_partkey") % 21 - 10
    a = x.select("l_orderkey", "l_linenumber", (v.cast("double") / 7).alias("v"))
    b = x.select("l_orderkey", "l_linenumber", ((v + F.col("l_suppkey") % 3 - 1).cast("double") / 7).alias("v"))
    return em.paired(a, b, ["l_orderkey", "l_linenumber"], "v")


_RUNS = """x AS (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey}) AS m FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, l_linenumber, (m.p % 21 - 10)::DOUBLE / 7 AS before, (m.p % 21 - 10 + m.s % 3 - 1)::DOUBLE / 7 AS after FROM x)"""


@query("j14_run_comparison", f"WITH {_RUNS} SELECT l_orderkey, l_linenumber, round(after - before, 9) AS delta FROM p")
def run_comparison(spark, sf):
    return _runs(spark, sf).select("l_orderkey", "l_linenumber", F.round("delta", 9).alias("delta"))


@query("a12_drift", f"WITH {_RUNS} SELECT count(*) AS pairs, round(max(abs(after - before)), 9) AS max_abs, round(avg(abs(after - before)), 6) AS mean_abs, count(*) FILTER ((before > 0) <> (after > 0)) AS flips, max(abs(after - before)) <= 0.0001 AS passed FROM p")
def drift(spark, sf):
    return em.drift(_runs(spark, sf)).withColumn("max_abs", F.round("max_abs", 9)).withColumn("mean_abs", F.round("mean_abs", 6))


@query("a11_eligibility_transitions", f"WITH {_RUNS} SELECT l_linenumber, CASE WHEN before > 0 AND after > 0 THEN 'kept' WHEN after > 0 THEN 'gained' WHEN before > 0 THEN 'lost' ELSE 'absent' END AS direction, count(*) AS n FROM p GROUP BY ALL")
def eligibility(spark, sf):
    return em.transitions(_runs(spark, sf), ["l_linenumber"])


@query("x36_hit_at_k", BM25_SQL + " SELECT query_id, bool_or(coalesce(lang = 'en', false)) AS hit, bool_and(length(text) > 0) AS complete FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def hit_at_k(spark, sf):
    """Whether each benchmark query has a document of its language of choice among its first five, and all with text."""
    docs = t(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return _bm25(spark, sf, 5).join(docs, "doc_id").groupBy("query_id").agg(F.max(F.coalesce(F.col("lang") == "en", F.lit(False))).alias("hit"), F.min(F.col("n") > 0).alias("complete"))


@query("l6_pair_plan", BM25_SQL + """, r AS (SELECT query_id, doc_id, rank, unnest(['symptoms', 'history']) AS role FROM bm WHERE rank <= 10)
SELECT query_id, role, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, role DESC) AS pair_no FROM r WHERE role = 'symptoms' OR query_id % 2 = 0""")
def pair_plan(spark, sf):
    """The pairs to score: each query's pool of ten under each of its roles, in a fixed order; every second query has no history."""
    pool = _bm25(spark, sf, 10).select("query_id", "doc_id", "rank", F.explode(F.array(F.lit("symptoms"), F.lit("history"))).alias("role"))
    pairs = pool.filter((F.col("role") == "symptoms") | (F.col("query_id") % 2 == 0)).withColumnRenamed("rank", "place")
    return rk.top(pairs, ["query_id"], [F.asc("place"), F.desc("role")], None, "pair_no").select("query_id", "role", "doc_id", "pair_no")


@query("l2_cross_scores", BM25_SQL + """, w AS (SELECT query_id, bm.doc_id, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda x: x <> '')) AS p FROM bm JOIN documents d ON d.doc_id = bm.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
SELECT query_id, doc_id, round(len(list_intersect(q, p))::DOUBLE / greatest(1, len(q)) - 0.5, 9) AS logit FROM w""")
def cross_scores(spark, sf):
    from siftstone.operators.models import LexicalScorer, cross_score

    docs = t(spark, sf, "documents").select("doc_id", "text")
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = _bm25(spark, sf, 10).select("query_id", "doc_id").join(queries, "query_id").join(docs, "doc_id")
    return cross_score(pairs, LexicalScorer(), "query", "text").select("query_id", "doc_id", F.round("logit", 9).alias("logit"))


@query("l3_l5_semantic_groups")
def groups(spark, sf):
    from siftstone.operators.selection import semantic_groups

    v = t(spark, sf, "embeddings")
    facts = v.select(F.floor(F.col("vec_id") / 12).cast("string").alias("case_id"), F.when(F.col("vec_id") % 3 == 0, "history").otherwise("symptoms").alias("kind"), F.col("vec_id").cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("vector"))
    return semantic_groups(facts)


@query("e2_tumbling_windows", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    """An extension: what the streaming window job gives when its stream has ended."""
    by = t(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return by.select("event_type", F.col("window.start").alias("start"), "n")

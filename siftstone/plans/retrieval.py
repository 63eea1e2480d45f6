"""Ranked retrieval over documents, benchmark texts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import ranking as rk
from siftstone.plans.base import query, t

_STOP = ", ".join(f"'{w}'" for w in tx.STOP)
_TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|is|us)$') THEN left(w, length(w) - 1) ELSE w END)"""
_D, _Q = _TOKENS.format("text"), _TOKENS.format("text")
#: BM25 of benchmark texts over documents as common table expressions, ending in scored(query_id, doc_id, score).
BM25_SQL = f"""WITH d AS (SELECT doc_id, {_D} AS toks FROM documents), dl AS (SELECT doc_id, toks, len(toks) AS n FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(toks) AS term FROM dl) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) AS nd, sum(n) AS total FROM dl),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_Q}) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (total / nd)))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 50)"""


def _queries(spark, sf):
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark, sf, depth=50, sizes=False):
    return rk.bm25(t(spark, sf, "documents"), _queries(spark, sf), depth=depth, sizes=sizes)


@query("a2_term_statistics", f"""WITH d AS (SELECT doc_id, {_D} AS toks FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM tf GROUP BY term""")
def term_statistics(spark, sf):
    docs = t(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    by = rk.postings(docs, "doc_id", "text", sizes=False).filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    return by.crossJoin(F.broadcast(n)).select("term", "df", "occurrences", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).alias("idf"))


@query("a3_bm25", BM25_SQL + " SELECT query_id, doc_id, score, rank FROM bm")
def bm25(spark, sf):
    return _bm25(spark, sf)


@query("w4_bm25_top5", BM25_SQL + " SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5")
def bm25_top5(spark, sf):
    return _bm25(spark, sf, 5)


@query("j5_inverted_index_join", f"""WITH p AS (SELECT DISTINCT doc_id, unnest({_D}) AS term FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest({_Q}) AS term FROM benchmark)
SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN p USING (term) GROUP BY ALL HAVING count(*) >= 3""")
def inverted_index(spark, sf):
    return rk.overlaps(t(spark, sf, "documents"), _queries(spark, sf), 3).drop("size")


#: A literal channel beside BM25: coverage of the document's distinct terms by the query's.
_LITERAL = f""", dt AS (SELECT doc_id, list_distinct(toks) AS terms FROM d), qd AS (SELECT query_id, list(term) AS qterms FROM qt GROUP BY query_id),
lit0 AS (SELECT query_id, doc_id, len(list_intersect(terms, qterms)) AS overlap, len(terms) AS size FROM qd, dt WHERE len(list_intersect(terms, qterms)) >= 2),
lit AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, size, doc_id) AS rank FROM lit0 QUALIFY rank <= 50),
r AS (SELECT query_id, 'bm25' AS channel, doc_id, rank FROM bm UNION ALL SELECT query_id, 'literal', doc_id, rank FROM lit),
f AS (SELECT query_id, doc_id, round(coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'bm25'), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'literal'), 0), 12) AS rrf, count(*) AS channels FROM r GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS fusion_rank FROM f)"""


def _literal(spark, sf):
    hits = rk.overlaps(t(spark, sf, "documents"), _queries(spark, sf), 2)
    return rk.top(hits, ["query_id"], [F.desc("overlap"), F.asc("size"), F.asc("doc_id")], 50)


def rankings(spark, sf):
    return _bm25(spark, sf, sizes=True).select("query_id", F.lit("bm25").alias("channel"), "doc_id", "rank").unionByName(_literal(spark, sf).select("query_id", F.lit("literal").alias("channel"), "doc_id", "rank"))


@query("a4_rrf", BM25_SQL + _LITERAL + " SELECT query_id, doc_id, rrf, channels, fusion_rank FROM fr WHERE fusion_rank <= 5")
def fused(spark, sf):
    return rk.rrf(rankings(spark, sf), ["query_id"], "doc_id").filter("fusion_rank <= 5").select("query_id", "doc_id", "rrf", F.size("origins").cast("long").alias("channels"), "fusion_rank")


@query("w5_fusion_order", BM25_SQL + _LITERAL + " SELECT query_id, doc_id, fusion_rank FROM fr")
def fusion_order(spark, sf):
    return rk.rrf(rankings(spark, sf), ["query_id"], "doc_id").select("query_id", "doc_id", "fusion_rank")


@query("a5_channel_strength", BM25_SQL + _LITERAL + " SELECT doc_id, channel, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS strength FROM r GROUP BY ALL")
def channel_strength(spark, sf):
    return rankings(spark, sf).groupBy("doc_id", "channel").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("strength"))


@query("a6_strongest_query", BM25_SQL + _LITERAL + """, st AS (SELECT doc_id, query_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS strength FROM r GROUP BY ALL)
SELECT doc_id, query_id, strength FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, query_id DESC) = 1""")
def strongest_query(spark, sf):
    return rk.strongest_query(rankings(spark, sf), ["doc_id"], "query_id")


@query("a9_pool_statistics", BM25_SQL + _LITERAL + " SELECT query_id, count(*) FILTER (channel = 'bm25') AS bm25_hits, count(*) FILTER (channel = 'literal') AS literal_hits, count(DISTINCT doc_id) AS pool, count(*) - count(DISTINCT doc_id) AS duplicates FROM r GROUP BY query_id")
def pool_statistics(spark, sf):
    is_ = lambda c: F.count_if(F.col("channel") == c)
    return rankings(spark, sf).groupBy("query_id").agg(is_("bm25").alias("bm25_hits"), is_("literal").alias("literal_hits"), F.countDistinct("doc_id").alias("pool"), (F.count("*") - F.countDistinct("doc_id")).alias("duplicates"))


@query("o1_union_of_channels", BM25_SQL + _LITERAL + " SELECT query_id, doc_id FROM bm UNION SELECT query_id, doc_id FROM lit")
def union_of_channels(spark, sf):
    return rankings(spark, sf).select("query_id", "doc_id").distinct()


@query("w10_depth_sweep", BM25_SQL + " SELECT query_id, depth, count(*) AS retained, min(doc_id) AS least_doc FROM bm, (VALUES (5), (10), (20), (50)) v(depth) WHERE rank <= depth GROUP BY ALL")
def depth_sweep(spark, sf):
    return rk.depth_sweep(_bm25(spark, sf), ["query_id"]).groupBy("query_id", "depth").agg(F.count("*").alias("retained"), F.min("doc_id").alias("least_doc"))


@query("w11_first_in_ranked_order", BM25_SQL + """ SELECT query_id, doc_id, rank, text_id FROM (SELECT bm.*, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_id FROM bm JOIN documents USING (doc_id))
QUALIFY row_number() OVER (PARTITION BY query_id, text_id ORDER BY rank) = 1""")
def first_in_ranked_order(spark, sf):
    texts = t(spark, sf, "documents").select("doc_id", F.md5(F.lower(tx.clean(F.col("text")))).alias("text_id"))
    return rk.first_of(_bm25(spark, sf).select("query_id", "doc_id", "rank").join(texts, "doc_id"), ["query_id", "text_id"], [F.asc("rank")]).select("query_id", "doc_id", "rank", "text_id")


@query("w9_lexical_rerank", BM25_SQL + """, j AS (SELECT query_id, doc_id, score, (source = 'src1')::INT AS title, (lang = 'en')::INT AS body, (n_chars > 2000)::INT AS history FROM bm JOIN documents USING (doc_id))
SELECT query_id, doc_id, 3 * title + 2 * body + history AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY 3 * title + 2 * body + history DESC, score DESC, doc_id) AS rank FROM j QUALIFY rank <= 5""")
def lexical_rerank(spark, sf):
    docs = t(spark, sf, "documents")
    j = _bm25(spark, sf).drop("rank").join(docs.select("doc_id", (F.col("source") == "src1").cast("int").alias("ti"), (F.col("lang") == "en").cast("int").alias("bo"), (F.col("n_chars") > 2000).cast("int").alias("hi")), "doc_id")
    scored = j.withColumn("lexical", rk.lexical_score(F.col("ti"), F.col("bo"), F.col("hi")))
    return rk.top(scored, ["query_id"], [F.desc("lexical"), F.desc("score"), F.asc("doc_id")], 5).select("query_id", "doc_id", "lexical", "rank")


def _vectors(spark, sf):
    v = t(spark, sf, "embeddings")
    return v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))  # the stated query set


_UNIT = "q AS (SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings WHERE vec_id % 20 = 0)"


@query("w1_knn_cosine", f"WITH {_UNIT} SELECT query_id, vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.u), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.u), 9) DESC, vec_id) AS rank FROM embeddings e, q QUALIFY rank <= 10")
def knn_cosine(spark, sf):
    v, q = _vectors(spark, sf)
    return rk.knn(v, q, 10)


@query("w2_knn_filtered", f"WITH {_UNIT} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.u), 9) DESC, vec_id) AS rank FROM embeddings e, q WHERE label IN (1, 3) QUALIFY rank <= 5")
def knn_filtered(spark, sf):
    v, q = _vectors(spark, sf)
    return rk.knn(v.filter(F.col("label").isin(1, 3)), q, 5).select("query_id", "vec_id", "rank")


_L2 = "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("w3_knn_l2_gate", f"SELECT q.vec_id AS query_id, e.vec_id, round({_L2}, 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 9), e.vec_id) AS rank, round({_L2}, 9) <= 1.1 AS within_gate FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0")
def knn_l2_gate(spark, sf):
    v, q = _vectors(spark, sf)
    return rk.knn(v, q, None, "l2").withColumn("within_gate", F.col("score") <= 1.1)


@query("p14_distance_gate", f"SELECT q.vec_id AS query_id, e.vec_id FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND (round({_L2}, 9) <= 1.1 OR e.label = q.label AND e.vec_id % 50 = 0)")
def distance_gate(spark, sf):
    v, q = _vectors(spark, sf)
    near = rk.knn(v, q, None, "l2", within=1.1).select("query_id", "vec_id")
    # an exact look-up needs no distance: a join by label of the vectors that may be looked up
    asked = v.select(F.col("vec_id").alias("query_id"), "label").join(q.select("query_id"), "query_id", "left_semi")
    exact = v.filter("vec_id % 50 = 0").select("vec_id", "label").join(asked, "label").select("query_id", "vec_id")
    return near.union(exact).distinct()


@query("j4_query_by_corpus", f"WITH {_UNIT} SELECT query_id, count(*) AS pairs, round(max(list_dot_product(e.embedding::DOUBLE[], q.u)), 9) AS best FROM embeddings e, q GROUP BY query_id")
def query_by_corpus(spark, sf):
    v, q = _vectors(spark, sf)
    return rk.best_products(v, q, "query_id")


@query("a7_best_semantic_score", f"WITH {_UNIT} SELECT vec_id, round(max(list_dot_product(e.embedding::DOUBLE[], q.u)), 9) AS semantic FROM embeddings e, q GROUP BY vec_id")
def best_semantic(spark, sf):
    v, q = _vectors(spark, sf)
    return rk.best_products(v, q, "vec_id").select("vec_id", F.col("best").alias("semantic"))


@query("p11_vector_constraint", "SELECT count(*) AS vectors, count(*) FILTER (len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))) AS well_formed FROM embeddings")
def vector_constraint(spark, sf):
    return t(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(vec.well_formed(F.col("embedding"), 64)).alias("well_formed"))


@query("p12_unit_norm", "SELECT vec_id, abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) <= 0.0001 AS unit FROM embeddings")
def unit_norm(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", vec.unit_length(F.col("embedding")).alias("unit"))


@query("m1_m3_distances", f"SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS dot, round({_L2}, 9) AS l2 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 9), e.vec_id) <= 10")
def distances(spark, sf):
    v = t(spark, sf, "embeddings")
    near = rk.knn(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, "l2").select("query_id", "vec_id")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return near.join(v, "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(vec.dot(F.col("embedding"), F.col("q")), 9).alias("dot"), F.round(vec.squared_l2(F.col("embedding"), F.col("q")), 9).alias("l2"))


@query("m2_renormalised", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 9) AS total FROM embeddings")
def renormalised(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(vec.unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("m5_role_ranking", BM25_SQL + " SELECT query_id, doc_id, round(score + 0.5 * (doc_id % 5) / greatest(1, doc_id % 7) + 0.1 * 0.25 + 0.1 / (60 + rank) + 0.2 * (doc_id % 2), 9) AS value FROM bm")
def role_value(spark, sf):
    d = F.col("doc_id")
    value = rk.role_ranking(F.col("score"), d % 5, d % 7, F.lit(0.25), 1.0 / (60 + F.col("rank")), d % 2)
    return _bm25(spark, sf).select("query_id", "doc_id", F.round(value, 9).alias("value"))


@query("w6_rerank_order", BM25_SQL + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7919) % 101 DESC, round(1.0::DOUBLE / (60 + rank), 12) DESC, doc_id) AS reranked FROM bm")
def rerank_order(spark, sf):
    b = _bm25(spark, sf).withColumn("logit", (F.col("doc_id") * 7919) % 101).withColumn("rrf", F.round(1.0 / (60 + F.col("rank")), 12)).drop("rank")
    return rk.top(b, ["query_id"], [F.desc("logit"), F.desc("rrf"), F.asc("doc_id")], None, "reranked").select("query_id", "doc_id", "reranked")


@query("w7_rank_delta", BM25_SQL + """, a AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7919) % 101 DESC, doc_id) AS other FROM bm)
SELECT query_id, doc_id, rank - other AS delta FROM a""")
def rank_delta(spark, sf):
    b = rk.top(_bm25(spark, sf).withColumn("logit", (F.col("doc_id") * 7919) % 101), ["query_id"], [F.desc("logit"), F.asc("doc_id")], None, "other")
    return b.select("query_id", "doc_id", (F.col("rank") - F.col("other")).alias("delta"))


def _selection_pool(spark, sf):
    """Fused pools of 50 with scores of two roles that hang on the id, as the selection reads them."""
    pool = rk.rrf(rankings(spark, sf), ["query_id"], "doc_id").filter("fusion_rank <= 50")
    docs = t(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    d = F.col("doc_id")
    met = pool.join(docs, "doc_id").withColumn("tokens", tx.word_set(F.col("text")))  # of pool rows alone
    return met.select(
        F.col("query_id").cast("string").alias("query_id"), d.cast("string").alias("chunk_id"), d.cast("string").alias("parent_id"), F.col("source").alias("document_id"), F.coalesce("lang", F.lit("")).alias("section"), "rrf",
        (d % 11 - 3).cast("double").alias("symptoms_score"), F.when(d % 3 == 0, (d % 5 - 1).cast("double")).alias("history_score"),
        ((d % 11 - 3) + F.col("rrf")).alias("symptoms_ranking"), ((d % 5 - 1) + F.col("rrf")).alias("history_ranking"),
        F.concat(F.lit("h"), (d % 4).cast("string")).alias("history_query"), (d % 7 == 0).alias("mismatch"), "tokens",
    )


@query("w13_w15_evidence_selection")
def evidence_selection(spark, sf):
    """W13 to W15: constrained selection over fused pools, with every decision's reason."""
    from siftstone.operators.selection import select_evidence

    return select_evidence(_selection_pool(spark, sf), 5).drop("ranking")


@query("w14_selection_variants")
def selection_variants(spark, sf):
    """What each variant selects of the same pools, and the counterfactual without a final budget."""
    from siftstone.operators.selection import VARIANTS, select_variants

    told = select_variants(_selection_pool(spark, sf), 5, (*((v, False) for v in VARIANTS), ("base", True)))
    return told.filter("event = 'selected'").select("variant", "unbounded", "query_id", "chunk_id", "role", F.round("ranking", 9).alias("ranking"))


@query("x15_selection_changes")
def selection_changed(spark, sf):
    """What each variant gains and loses against the base."""
    from siftstone.operators.selection import select_variants, selection_changes

    return selection_changes(select_variants(_selection_pool(spark, sf), 5))


@query("p15_positive_gate", BM25_SQL + " SELECT query_id, doc_id, (doc_id % 11 - 3)::DOUBLE AS logit FROM bm WHERE doc_id % 11 > 3")
def positive_gate(spark, sf):
    """Slots are never filled with rows of a score that is not positive."""
    from siftstone.operators.selection import positive

    scored = _bm25(spark, sf).select("query_id", "doc_id", (F.col("doc_id") % 11 - 3).cast("double").alias("logit"))
    return positive(scored, "logit")


@query("w8_catalog_lookup", f"""WITH e AS (SELECT p_partkey, lower(p_name) AS topic, p_type AS kind, p_brand AS file, p_partkey::VARCHAR AS url, string_split(lower(p_name), ' ') AS ph, list_distinct(string_split(lower(p_name), ' ')) AS terms FROM part),
q AS (SELECT p_partkey AS query_id, string_split(lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' please' ELSE ' x' END, ' ') AS ws FROM part WHERE p_partkey % 20 = 0),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM e) GROUP BY 1),
m AS (SELECT query_id, p_partkey AS entry_id, topic, kind, file, url, len(list_intersect(terms, ws)) AS overlap, round(len(list_intersect(terms, ws))::DOUBLE / len(terms), 9) AS coverage,
 CASE WHEN ws = ph THEN 3 WHEN contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(ph, ' ') || ' ') THEN 2
 WHEN len(list_intersect(terms, ws)) >= 2 THEN 1 WHEN len(list_intersect(terms, ws)) = 1 AND (SELECT min(df) FROM f WHERE list_contains(list_intersect(terms, ws), term)) <= 2 THEN 1 END AS strength FROM q, e WHERE len(list_intersect(terms, ws)) > 0)
SELECT query_id, entry_id, ['partial', 'topic_phrase', 'exact'][strength] AS match, overlap, coverage, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, overlap DESC, coverage DESC, topic, kind, file, url) AS rank FROM m WHERE strength IS NOT NULL QUALIFY rank <= 5""")
def catalog_lookup(spark, sf):
    from siftstone.operators.catalog import lookup

    p = t(spark, sf, "part").withColumn("topic", F.lower("p_name")).withColumn("ph", F.split(F.lower("p_name"), " "))
    entries = p.select(F.col("p_partkey").alias("entry_id"), "topic", F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_partkey").cast("string").alias("url"), F.array("ph").alias("phrases"), F.array_distinct("ph").alias("terms"))
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " please").otherwise(" x")
    asked = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat("topic", tail).alias("query")).withColumn("words", F.split("query", " "))
    return lookup(entries, asked, ["the"], 5)

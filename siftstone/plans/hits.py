"""Hits, strict JSON, topics among hits and captured ranks, each with faults planted by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import documents as dc
from siftstone.operators import hits as hi
from siftstone.operators import ranking as rk
from siftstone.operators.constraints import Violation
from siftstone.plans.base import query, t
from siftstone.plans.retrieval import BM25_SQL, _bm25
from siftstone.session import kept, workspace
from siftstone.sources import sinks as sk

SOURCE, HOST = "library", "example.org"
_P = (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43)
_RULE = dict(zip(_P, ["envelope", "metadata", "retrieval", "identity", "binding", "url", "checksum", "tokens", "spans", "distance", "gate"], strict=True))


@query("p9_hit_faults", f"""WITH d AS (SELECT doc_id, trim(text) = '' AS blank FROM documents)
SELECT doc_id, unnest(list_distinct(list_filter([{", ".join(f"CASE WHEN doc_id % {n} = 0 THEN '{r}' END" for n, r in _RULE.items())}, CASE WHEN blank THEN 'checksum' END, CASE WHEN doc_id % 11 = 0 THEN 'identity' END], lambda x: x IS NOT NULL))) AS rule FROM d""")
def hit_faults(spark, sf):
    """Whole documents as hits in JSON. Every 7th has a field too many, every 11th its number as text (so it has no identity either), and so on: each number plants the fault of one rule."""
    d = F.col("doc_id")
    p = lambda n, wrong, right: F.when(d % n == 0, wrong).otherwise(right)
    topic = F.concat(F.lit("library:topic:"), d.cast("string"))
    url = p(23, F.concat(F.lit("http://example.org/"), d.cast("string")), F.concat(F.lit("https://example.org/"), d.cast("string")))
    span = F.struct(p(37, F.length("text"), F.lit(0)).alias("start"), F.greatest(F.length("text"), F.lit(1)).alias("end"), F.lit(False).alias("split"))
    sha = F.sha2("text", 256)
    meta = [d.cast("string").alias("topic_id"), topic.alias("parent_id"), (d % 5).alias("chunk"), F.lit("T").alias("title"), url.alias("url"), p(29, F.sha2(sha, 256), sha).alias("chunk_sha256"), sha.alias("content_sha256"), p(31, F.lit(257), F.lit(256)).alias("tokens"), F.array(span).alias("spans")]
    retrieval = F.struct(
        F.when(d % 41 == 0, F.lit(-0.5)).when(d % 43 == 0, F.lit(1.5)).otherwise(F.lit(0.5)).alias("distance"), F.lit(1.25).alias("max_distance"), p(13, F.lit("cosine"), F.lit("squared_l2")).alias("metric"),
        F.when((d % 3 == 0) & (d % 43 != 0), "exact_source_lookup").otherwise("distance_gate").alias("acceptance"), F.substring(sha, 1, 24).alias("snapshot"),
    )
    text = F.to_json(
        F.struct(
            F.concat(topic, p(17, F.lit(":part:"), F.lit(":chunk:")), (d % 5).cast("string")).alias("chunk_id"), topic.alias("document_id"), F.lit("library").alias("source"), p(19, F.lit("U"), F.lit("T")).alias("title"), url.alias("url"), "text",
            F.struct(*meta).alias("metadata"), retrieval.alias("retrieval"), p(7, F.lit(1), F.lit(None)).alias("more"),
        )
    )
    text = F.when(d % 11 == 0, F.regexp_replace(text, '"chunk":([0-9])', '"chunk":"$1"')).otherwise(text)
    text = F.when((d % 43 == 0) & (d % 41 == 0), F.regexp_replace(text, '"acceptance":"[a-z_]*"', '"acceptance":"rejected"')).otherwise(text)
    return hi.hit_faults(t(spark, sf, "documents").select("doc_id", text.alias("json")), "doc_id", "json", SOURCE, HOST)


@query("r8_strict_faults", """WITH e AS (SELECT event_id, event_id % 7 AS m FROM events)
SELECT event_id, CASE m WHEN 1 THEN '/k' WHEN 2 THEN '/k' WHEN 3 THEN '/flag' WHEN 4 THEN '/more' WHEN 5 THEN '/' ELSE '/' END AS path, CASE m WHEN 1 THEN 'kind' WHEN 2 THEN 'missing' WHEN 3 THEN 'kind' WHEN 4 THEN 'unexpected' WHEN 5 THEN 'not_an_object' ELSE 'not_json' END AS fault FROM e WHERE m > 0""")
def strict_faults(spark, sf):
    """The props of events as answers of a model: a figure as text, a missing field, a 1 for true, a field too many, a list, a text with a fence around it."""
    m, k = F.col("event_id") % 7, F.get_json_object("props", "$.k")
    text = (
        F.when(m == 1, F.concat(F.lit('{"flag": true, "k": "'), k, F.lit('"}'))).when(m == 2, '{"flag": false}').when(m == 3, F.concat(F.lit('{"flag": 1, "k": '), k, F.lit("}"))).when(m == 4, F.concat(F.lit('{"flag": true, "more": null, "k": '), k, F.lit("}")))
        .when(m == 5, F.concat(F.lit("["), k, F.lit("]"))).when(m == 6, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "flag": false}')))
    )
    return hi.strict_faults(t(spark, sf, "events").select("event_id", text.alias("json")), "event_id", "json", {"k": "integer", "flag": "boolean"})


# A query's expected title is that of one of its first eight documents. Some hits are headed by a question for it, some have no licence; every ninth query expects what nothing has.
_HITS_SQL = BM25_SQL + """, ti AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents), ex AS (SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'nothing' ELSE title END AS want FROM bm JOIN ti USING (doc_id) WHERE rank = 1 + query_id % 8),
h AS (SELECT query_id, want, title = want AS t, title <> want AND (query_id + doc_id) % 6 = 0 AND query_id % 9 > 0 AS d, doc_id % 23 > 0 AS w FROM ex JOIN bm USING (query_id) JOIN ti USING (doc_id) WHERE rank <= 5)"""


@query("x36_topic_hits", _HITS_SQL + """ SELECT query_id, count(*) AS hits, bool_and(w) AS whole, bool_or(t) AS title_match, bool_or(d) AS definition_match, bool_and(w) AND (bool_or(t) OR bool_or(d)) AS passed FROM h GROUP BY query_id""")
def topic_hits(spark, sf):
    ranked, q, d = kept(_bm25(spark, sf, 8)), F.col("query_id"), F.col("doc_id")
    titles = t(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"), "text", "source")
    met = ranked.join(titles, "doc_id")
    want = met.filter(F.col("rank") == 1 + q % 8).select("query_id", F.when(q % 9 == 0, "nothing").otherwise(F.col("title")).alias("want"))
    headed = F.when(((q + d) % 6 == 0) & (q % 9 != 0), F.concat(F.when(d % 2 == 0, "What is ").otherwise("WHAT ARE "), F.col("want"), F.lit("?"))).otherwise("Overview")
    found = met.filter("rank <= 5").join(want, "query_id").select("query_id", "title", headed.alias("section"), "text", F.concat(F.lit("documents/"), d.cast("string")).alias("provenance"), F.when(d % 23 != 0, "CC0").alias("licence"))
    return hi.topic_hits(found, want.select("query_id", F.array("want", F.lit("another")).alias("titles")))


# Two captured systems of each pool: a ranking to 50, and five of its candidates in another order. Of every eight pools five have a fault of their own.
@query("w19_rank_faults", BM25_SQL + """, c AS (SELECT query_id AS pool_id, count(*) AS n FROM bm GROUP BY 1)
SELECT pool_id, unnest(CASE pool_id % 8 WHEN 1 THEN ['first'] WHEN 2 THEN ['first', 'first'] WHEN 3 THEN ['second'] WHEN 4 THEN ['first', 'second'] ELSE ['first'] END) AS system, unnest(CASE pool_id % 8 WHEN 1 THEN ['count'] WHEN 2 THEN ['count', 'ranks'] WHEN 3 THEN ['parent'] WHEN 4 THEN ['ranks', 'parent'] ELSE ['depth'] END) AS fault FROM c WHERE pool_id % 8 BETWEEN 1 AND 5 AND n >= 6""")
def rank_faults(spark, sf):
    """One says another number, one has lost its first, one reorders with another score, one has all ranks one too high, one was captured beyond its depth."""
    p = F.col("pool_id") % 8
    whole = kept(_bm25(spark, sf).select(F.col("query_id").alias("pool_id"), F.col("doc_id").alias("candidate_id"), "rank", "score"))
    size = whole.groupBy("pool_id").agg(F.count("*").alias("n")).filter("n >= 6")
    whole = whole.join(size, "pool_id")
    first = whole.filter((p != 2) | (F.col("rank") != 1)).select("pool_id", F.lit("first").alias("system"), "candidate_id", (F.col("rank") + F.when(p == 4, 1).otherwise(0)).alias("rank"), F.lit(None).cast("int").alias("original_rank"), "score")
    five = rk.top(whole.filter("rank <= 6 and rank > 1").withColumnRenamed("rank", "was"), ["pool_id"], [F.desc("candidate_id")], 5)
    second = five.select("pool_id", F.lit("second").alias("system"), "candidate_id", "rank", F.col("was").cast("int").alias("original_rank"), (F.col("score") + F.when((p == 3) & (F.col("rank") == 2), 1.0).otherwise(0.0)).alias("score"))
    told = F.array(
        F.struct(F.lit("first").alias("system"), (F.col("n") + F.when(p == 1, 1).otherwise(0)).alias("returned"), F.when(p == 5, F.col("n") - 1).otherwise(F.lit(51)).alias("depth"), F.lit(None).cast("string").alias("parent")),
        F.struct(F.lit("second").alias("system"), F.lit(5).cast("long").alias("returned"), F.lit(5).cast("long").alias("depth"), F.lit("first").alias("parent")),
    )
    return hi.rank_faults(first.unionByName(second), size.select("pool_id", F.inline(told)))


def _refused(make) -> bool:
    """Whether a step fails closed."""
    try:
        make()
    except Violation:
        return True
    return False


@query("k2_created_records", "SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, sha256(event_type || '|' || props) AS sha, true AS same_name, true AS again FROM events")
def created_records(spark, sf):
    """All events as audit records in two batches. A batch under a name that is taken, and records that another batch has, are refused and leave nothing."""
    at = workspace(spark) + "/records"
    e = t(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", "event_type", "props").alias("payload"))
    part = lambda k: e.filter(F.col("event_id") % 2 == k)
    create = lambda df, batch: sk.create_records(df, at, batch, ["event_id"], F.col("payload"))
    create(part(0), "even")
    same_name, again = _refused(lambda: create(part(1), "even")), _refused(lambda: create(e, "all"))
    create(part(1), "odd")
    return spark.read.parquet(at).select("user_id", "event_id", "batch", "sha", F.lit(same_name).alias("same_name"), F.lit(again).alias("again"))


@query("k5_valid_upsert", """WITH n AS (SELECT count(*) FILTER (vec_id % 3 = 0) AS n FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'stored' END AS payload, n AS taken, true AS refused FROM embeddings, n""")
def valid_upsert(spark, sf):
    """A third of the vectors come again, each twice: the last one stays. The same batch with one vector of zeros among rows that would be replaced is refused whole."""
    stored = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit("stored").alias("payload"))
    some = stored.filter("vec_id % 3 = 0")
    batch = some.withColumn("payload", F.lit("first")).withColumn("seq", F.lit(1)).unionByName(some.withColumn("payload", F.lit("second")).withColumn("seq", F.lit(2)))
    size = stored.select(F.size("v")).first()[0]
    put = lambda b: dc.upsert_valid(stored, b, "vec_id", "seq", {"payload": F.col("payload") != ""}, "v", size)
    zeros = F.when((F.col("vec_id") == 0) & (F.col("seq") == 1), F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    refused = _refused(lambda: put(batch.withColumn("v", zeros)))
    after, taken = put(batch)
    return after.select("vec_id", "payload", F.lit(taken).cast("long").alias("taken"), F.lit(refused).alias("refused"))

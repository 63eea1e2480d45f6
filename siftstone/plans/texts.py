"""Text, address, identifier and array functions over documents, pages, benchmark texts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import ids, urls
from siftstone.functions import text as tx
from siftstone.operators import documents as dc
from siftstone.operators import evidence as ev
from siftstone.operators import packing as pk
from siftstone.plans.base import query, t

_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP)
_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("f1_f2_clean_text", f"SELECT doc_id, md5({_CLEAN}) AS cleaned, length({_CLEAN}) AS n FROM documents")
def clean(spark, sf):
    c = tx.clean(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("long").alias("n"))


#: The given texts have no character that the compatibility form changes beyond the canonical one: for such the tests are there.
@query("f1_clean_nfkc", "SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM documents")
def clean_nfkc(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.clean_nfkc(F.col("text")).alias("text"))


@query("f3_search_tokens", f"""SELECT doc_id, array_to_string(list_transform(list_filter({_WORDS}, lambda w: length(w) > 2 AND w NOT IN ({_STOP})),
 lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|is|us)$') THEN left(w, length(w) - 1) ELSE w END), ' ') AS tokens FROM documents""")
def search_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(tx.search_tokens(F.col("text")), " ").alias("tokens"))


_FOLDED = "replace(lower(strip_accents({0})), 'ß', 'ss')"


@query("f4_f7_catalog_tokens", f"SELECT doc_id, regexp_extract_all({_FOLDED.format('text')}, '[\\p{{L}}\\p{{N}}]+') AS tokens, array_to_string(regexp_extract_all(lower(nfc_normalize(source)), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS key FROM documents")
def catalog_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.catalog_tokens(F.col("text")).alias("tokens"), tx.alias_key(F.col("source")).alias("key"))


@query("f5_word_set", f"SELECT doc_id, len(list_distinct({_WORDS})) AS n, array_to_string(list_sort(list_distinct({_WORDS})), ' ') AS words FROM documents")
def word_set(spark, sf):
    w = tx.word_set(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.array_sort(w), " ").alias("words"))


@query("f6_informative", f"SELECT doc_id, len(list_distinct(list_filter({_WORDS}, lambda w: w NOT IN ({_STOP})))) AS n FROM documents")
def informative(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(tx.informative(tx.letters(F.col("text")), tx.STOP)).cast("long").alias("n"))


@query("f8_plain_label", "SELECT p_partkey, CASE WHEN trim(p_name) <> '' AND NOT regexp_matches(trim(p_name), '\\b[EV]_\\d+\\b') THEN trim(p_name) END AS label FROM part")
def plain_label(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.plain_label(F.col("p_name")).alias("label"))


_LEADS = ("Do you have ", "do you feel ", "Have you ever had ", "HAVE YOU RECENTLY HAD ", "Have you ", "Are you ", "Is your  ", "Do you ", "Characterize your ", "Are we ", "")
_COMPACT = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}', 'i') THEN coalesce(nullif(regexp_replace(b, '{p}', '{put}', 'i'), ''), b)" for p, put in tx.OPENINGS) + " ELSE b END"


@query("f9_compact_question", f"""WITH q AS (SELECT item_id, trim([{', '.join(f"'{x}'" for x in _LEADS)}][(item_id % {len(_LEADS)} + 1)::INT] || {_CLEAN} || ['', '?', '?:'][(item_id % 3 + 1)::INT]) AS q FROM benchmark), x AS (SELECT item_id, trim(regexp_replace(q, '[?:]+$', '')) AS b FROM q) SELECT item_id, {_COMPACT} AS short FROM x""")
def compact(spark, sf):
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (F.col("item_id") % len(of) + 1).cast("int"))
    q = F.concat(pick(_LEADS), tx.clean(F.col("text")), pick(("", "?", "?:")))
    return t(spark, sf, "benchmark").select("item_id", tx.compact_question(q).alias("short"))


@query("f10_p13_concepts", f"""SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'fever wheezing' WHEN len(c) > 0 THEN array_to_string(c[1:6], ' ') ELSE '' END AS concepts FROM (
 SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS w,
 list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x) AS c FROM benchmark)""")
def concept_names(spark, sf):
    text = F.when(F.col("item_id") % 4 == 0, F.concat(F.col("text"), F.lit(" Fever and wheezing"))).otherwise(F.col("text"))
    return t(spark, sf, "benchmark").select("item_id", F.array_join(tx.concepts(text), " ").alias("concepts"))


_ENTITIES = {"&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&#x27;": "''", "&nbsp;": " ", "&amp;": "&"}


def _bare_sql(html: str) -> str:
    """The text of a piece of HTML without scripts and styles; block elements part words."""
    blocks = "p|div|li|ul|ol|br|tr|td|th|table|section|article|header|footer|h[1-6]|title"
    out = f"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?i)</?(?:{blocks})(?:\\s[^>]*)?/?>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    for entity, char in _ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("f12_html_text", f"SELECT page_id, {_bare_sql('html')} AS text FROM pages")
def html_text(spark, sf):
    from siftstone.sources.html import plain_text

    return t(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


@query("f13_f14_html_sections", f"""WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<nav.*?</nav>', '', 'g') AS html FROM pages), s AS (SELECT page_id, unnest(list_concat([('', split_part(html, '<h1>', 1))], [(split_part(x, '</h1>', 1), split_part(x, '</h1>', 2)) for x in string_split(html, '<h1>')[2:]])) AS s FROM h),
p AS (SELECT page_id, {_bare_sql('s[1]')} AS title, {_bare_sql('s[2]')} AS text FROM s) SELECT * FROM p WHERE title <> '' OR text <> ''""")
def html_sections(spark, sf):
    from siftstone.sources.html import sections

    return t(spark, sf, "pages").select("page_id", F.explode(sections(F.col("html"))).alias("s")).select("page_id", "s.title", "s.text")


_WIN = f"""w AS (SELECT doc_id, list_filter(string_split({_CLEAN}, ' '), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i::INT AS i, array_to_string(ws[i * 150 + 1 : i * 150 + 180], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 180) / 150.0))::INT + 1)) AS i FROM w WHERE len(ws) > 0)),
ch AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS chunk_index FROM win GROUP BY doc_id, text)"""


@query("f16_word_windows", f"WITH {_WIN} SELECT doc_id, chunk_index::INT AS chunk_index, md5(text) AS digest FROM ch")
def word_windows(spark, sf):
    return dc.chunks(t(spark, sf, "documents")).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("f20_chunk_ids", f"""WITH {_WIN}, h AS (SELECT doc_id, chunk_index, sha1(unhex('{ids.URL_SPACE}') || encode('medical-knowledge/' || doc_id || '/{dc.VERSION}/' || chunk_index || '/' || sha256(text))) AS h FROM ch)
SELECT doc_id, chunk_index::INT AS chunk_index, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', (strpos('0123456789abcdef', substr(h, 17, 1)))::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""")
def chunk_ids(spark, sf):
    return dc.chunks(t(spark, sf, "documents")).select("doc_id", "chunk_index", "chunk_id")


@query("f21_short_ids", "SELECT doc_id, sha256(text) AS digest, 'w:' || left(sha256(text), 12) AS short FROM documents")
def short_ids(spark, sf):
    return t(spark, sf, "documents").select("doc_id", ids.digest(F.col("text")).alias("digest"), ids.short_id(F.col("text")).alias("short"))


@query("f22_canonical_json", """SELECT c_custkey, '{"key":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS json FROM customer""")
def canonical(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", ids.canonical_json(key=F.col("c_custkey"), segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("json"))


@query("f19_prefix_excerpt", """SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN contains(left(text, 400), chr(10)) THEN left(text, 400 - strpos(reverse(left(text, 400)), chr(10))) ELSE left(text, 400) END) AS digest FROM documents""")
def excerpt(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(tx.excerpt(F.col("text"), 400)).alias("digest"))


@query("f24_list_phrase", """WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)
SELECT n_regionkey, CASE WHEN len(l) <= 1 THEN array_to_string(l, '') ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS phrase FROM g""")
def list_phrase(spark, sf):
    g = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", tx.joined(F.col("l")).alias("phrase"))


@query("f25_role_templates", "SELECT item_id, 'Role: ' || CASE item_id % 2 WHEN 0 THEN 'symptoms' ELSE 'history' END || '. Query: ' || text AS q FROM benchmark")
def role_templates(spark, sf):
    role = F.when(F.col("item_id") % 2 == 0, "symptoms").otherwise("history")
    return t(spark, sf, "benchmark").select("item_id", F.format_string("Role: %s. Query: %s", role, F.col("text")).alias("q"))


@query("f27_printable", "SELECT doc_id, length(text) > 80 AS cut, md5(CASE WHEN length(x) > 80 THEN left(x, 80) || '...' ELSE x END) AS digest FROM (SELECT doc_id, text, regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g') AS x FROM documents)")
def printable(spark, sf):
    return t(spark, sf, "documents").select("doc_id", (F.length("text") > 80).alias("cut"), F.md5(tx.printable(F.col("text"), 80)).alias("digest"))


@query("f28_same_text", f"WITH a AS (SELECT lower({_CLEAN}) AS k, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1) SELECT first, n FROM a WHERE n > 1")
def same_text(spark, sf):
    return t(spark, sf, "documents").groupBy(F.lower(tx.clean(F.col("text"))).alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select("first", "n")


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages"


@query("s18_link_discovery", f"WITH l AS ({_LINKS}) SELECT link, count(*) AS seen, count(DISTINCT page_id) AS pages FROM l GROUP BY link")
def link_discovery(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link")).groupBy("link").agg(F.count("*").alias("seen"), F.countDistinct("page_id").alias("pages"))


@query("p20_canonical_url", """SELECT page_id, 'https://' || lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') AS url FROM pages""")
def canonical_url(spark, sf):
    return t(spark, sf, "pages").select("page_id", urls.bare(F.col("url")).alias("url"))


@query("x29_topic_and_file", """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+/en/([0-9]+)/*', 1) AS topic, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN topic <> '' AND h LIKE '%.example.com' THEN topic || '.txt' END AS file FROM p""")
def topic_and_file(spark, sf):
    p = t(spark, sf, "pages").withColumn("topic", F.regexp_extract("url", r"^https?://[^/?#]+/en/([0-9]+)/*", 1))
    return p.select("page_id", F.when((F.col("topic") != "") & urls.host(F.col("url")).like("%.example.com"), urls.file_name(F.col("topic"))).alias("file"))


@query("f23_reserved_names", "SELECT n_nationkey, CASE WHEN regexp_matches(x, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$', 'i') THEN '_' ELSE '' END || x || '.txt' AS file FROM (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'CON' WHEN 1 THEN 'lpt3' ELSE n_name END AS x FROM nation)")
def reserved_names(spark, sf):
    k = F.col("n_nationkey") % 5
    return t(spark, sf, "nation").select("n_nationkey", urls.file_name(F.when(k == 0, "CON").when(k == 1, "lpt3").otherwise(F.col("n_name"))).alias("file"))


@query("p19_licences", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'CC-BY-SA-3.0-IGO' WHEN 2 THEN 'CC0-1.0' END AS licence FROM nation""")
def licences(spark, sf):
    k = F.col("n_nationkey") % 4
    url = F.when(k == 0, "https://creativecommons.org/licenses/by/4.0/").when(k == 1, "http://www.creativecommons.org/licenses/by-sa/3.0/igo").when(k == 2, "https://creativecommons.org/publicdomain/zero/1.0/").otherwise("https://creativecommons.org/licenses/by-nc/4.0/")
    return t(spark, sf, "nation").select("n_nationkey", urls.open_licence(url).alias("licence"))


@query("w18_budget_packing", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT o_custkey, 0::BIGINT AS i, 0::BIGINT AS used, ''::VARCHAR AS kept FROM (SELECT DISTINCT o_custkey FROM o) UNION ALL
 SELECT w.o_custkey, o.i, CASE WHEN w.used + length(o_orderpriority) + (w.used > 0)::INT <= 30 THEN w.used + length(o_orderpriority) + (w.used > 0)::INT ELSE w.used END,
 CASE WHEN w.used + length(o_orderpriority) + (w.used > 0)::INT <= 30 THEN w.kept || CASE WHEN w.used > 0 THEN '|' ELSE '' END || o_orderpriority ELSE w.kept END FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.i = w.i + 1)
SELECT o_custkey, kept FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1""")
def budget_packing(spark, sf):
    rows = t(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))
    return rows.select("o_custkey", F.array_join(pk.pack(F.col("l"), 30), "|").alias("kept"))


@query("w17_round_robin", """WITH n AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n, o_orderpriority) AS turn FROM n""")
def round_robin(spark, sf):
    return pk.round_robin(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", F.asc("o_orderkey"), F.asc("o_orderpriority")).select("o_orderkey", "turn")


@query("o6_near_duplicate_pairs", f"""WITH d AS (SELECT source, list_sort(list_distinct({_WORDS})) AS w, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY ALL)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) AS jaccard, a.n AS copies_a, b.n AS copies_b FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id
WHERE len(list_intersect(a.w, b.w)) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8""")
def near_pairs(spark, sf):
    return dc.similar_pairs(t(spark, sf, "documents").select("doc_id", "source", tx.word_set(F.col("text")).alias("words")), "doc_id", "source", "words", 80)


@query("o7_stable_distinct", "SELECT conv_id, array_to_string(list_transform(list_sort(list(DISTINCT {'t': t, 'r': role})), lambda x: x.r), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def stable_distinct(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(rows), ",").alias("roles"))


@query("w12_first_wins", f"WITH {_WIN} SELECT doc_id, chunk_index::INT AS chunk_index FROM ch QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk_index) = 1")
def first_wins(spark, sf):
    return dc.first_wins(dc.chunks(t(spark, sf, "documents")), "text", ["doc_id", "chunk_index"]).select("doc_id", "chunk_index")


@query("a24_suppressed_chunks", f"WITH {_WIN} SELECT count(*) AS chunks, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS suppressed FROM ch")
def suppressed(spark, sf):
    return dc.chunks(t(spark, sf, "documents")).agg(F.count("*").alias("chunks"), F.countDistinct("text").alias("kept"), (F.count("*") - F.countDistinct("text")).alias("suppressed"))


@query("a8_duplicate_documents", f"SELECT source, count(*) AS docs, count(DISTINCT lower({_CLEAN})) AS texts FROM documents GROUP BY source")
def duplicate_documents(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct(F.lower(tx.clean(F.col("text")))).alias("texts"))


@query("a1_counts_by_source", "WITH s AS (SELECT unnest(['src0', 'src1', 'none']) AS source) SELECT s.source, count(d.doc_id) AS n FROM s LEFT JOIN documents d USING (source) GROUP BY 1")
def counts(spark, sf):
    docs = t(spark, sf, "documents")
    return dc.counts_by(docs, spark.createDataFrame([("src0",), ("src1",), ("none",)], "source string"), "source")


@query("k5_upsert", "WITH b AS (SELECT c_custkey, c_name || '!' AS c_name FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_name FROM b UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def upsert(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name")
    some = c.filter("c_custkey % 3 = 0")
    batch = some.withColumn("seq", F.lit(1)).unionByName(some.withColumn("c_name", F.concat("c_name", F.lit("!"))).withColumn("seq", F.lit(2)))
    return dc.upsert(c, batch, "c_custkey", "seq")


@query("p24_unseen_urls", """SELECT page_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(html, '(https?://[^\\s<>"'']+)', 1), lambda u: regexp_replace(u, '[.,;:)\\]]+$', ''))), lambda u: NOT contains(url, u))) AS unseen FROM pages""")
def unseen_urls(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.size(ev.unseen_urls(F.col("html"), F.col("url"))).cast("long").alias("unseen"))


@query("f18_spans_merged", """WITH p AS (SELECT doc_id, unnest(range(0, length(text), 97)) AS s FROM documents), x AS (SELECT doc_id, s AS start, s + 40 + (s % 80) AS "end" FROM p),
g AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT doc_id, min(start)::INT AS start, max("end")::INT AS "end" FROM i GROUP BY doc_id, island""")
def spans_merged(spark, sf):
    d = t(spark, sf, "documents").filter(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(97))).alias("start"))
    return ev.merge_spans(d.withColumn("end", F.col("start") + 40 + F.col("start") % 80), ["doc_id"])


@query("p26_population", """SELECT p_partkey, CASE WHEN p_size IS NULL OR p_partkey % 3 = 2 THEN 'unknown' WHEN p_partkey % 3 = 0 AND p_size >= 18 OR p_partkey % 3 = 1 AND p_size <= 17 THEN 'match' ELSE 'mismatch' END AS status FROM part""")
def population(spark, sf):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, "Asthma in Adults").when(k == 1, "Asthma in children").otherwise("Asthma")
    return t(spark, sf, "part").select("p_partkey", ev.population_status(F.col("p_size"), title).alias("status"))


@query("l1_embedding_signature")
def embedded(spark, sf):
    from siftstone.operators.models import HashingEmbedder, embed

    return embed(t(spark, sf, "benchmark"), HashingEmbedder(64), "item_id", "text")


_FAR = "(SELECT min(1 - len(list_intersect(b.w, c.w)) / greatest(1, len(b.w) + len(c.w) - len(list_intersect(b.w, c.w)))) FROM b c WHERE c.row_no IN ({0}))"


def _diverse_sql(k: int) -> str:
    """The choice turn by turn: c1 is the anchor, c2 the farthest from it, and so on; ties go to the lower row."""
    steps = ["c1 AS (SELECT 0 AS turn, min(row_no) AS row_no FROM b)"]
    for i in range(2, k + 1):
        chosen = " UNION ALL ".join(f"SELECT row_no FROM c{j}" for j in range(1, i))
        steps.append(f"c{i} AS (SELECT {i - 1} AS turn, row_no FROM b WHERE row_no NOT IN ({chosen}) ORDER BY round({_FAR.format(chosen)}, 12) DESC, row_no LIMIT 1)")
    return f"WITH b AS (SELECT item_id AS row_no, list_distinct({_WORDS}) AS w FROM benchmark), " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT turn, row_no FROM c{j}" for j in range(1, k + 1))


@query("w16_diversity_sample", _diverse_sql(5))
def diversity(spark, sf):
    from siftstone.operators.selection import diverse

    rows = t(spark, sf, "benchmark").select(F.col("item_id").alias("row_no"), tx.word_set(F.col("text")).alias("items"))
    return spark.createDataFrame([(i, r) for i, r in enumerate(diverse(rows, 5))], "turn int, row_no long")


@query("j6_phrase_join", "WITH q AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: true)[1:3] AS p FROM benchmark) SELECT item_id, doc_id FROM q, documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')")
def phrase_join(spark, sf):
    """Phrases meet documents by their first two words; the whole phrase is checked on what meets."""
    w = tx.letters(F.col("text"))
    q = t(spark, sf, "benchmark").select("item_id", F.slice(w, 1, 3).alias("p")).withColumn("k", F.concat_ws(" ", F.get("p", 0), F.get("p", 1)))
    d = t(spark, sf, "documents").select("doc_id", w.alias("w"))
    pairs = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)), lambda a, b: F.concat_ws(" ", a, b)))
    met = d.select("doc_id", F.explode(pairs).alias("k")).join(q, "k").select("doc_id", "item_id", "p")
    return met.join(d, "doc_id").filter(tx.contains_phrase(F.col("w"), F.col("p"))).select("item_id", "doc_id")

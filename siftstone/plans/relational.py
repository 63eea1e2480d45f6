"""Joins, aggregations, set operations, constraints, dates and JSON over the relational tables and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions import vectors as vec
from siftstone.operators import cases as cs
from siftstone.operators import constraints as co
from siftstone.operators import evidence as ev
from siftstone.operators import ranking as rk
from siftstone.plans.base import query, t


@query("p1_allowlist_projection", "SELECT c_custkey, c_mktsegment FROM customer")
def allowlist(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment")


@query("p2_canonical_text", """SELECT c_custkey, 'Segment' || chr(10) || '- ' || c_mktsegment || chr(10) || 'Orders' || chr(10) || coalesce(string_agg('- ' || o_orderkey, chr(10) ORDER BY o_orderkey), 'Not supplied') AS text
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def canonical_text(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    by = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_mktsegment").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    lines = F.when(F.size("k") == 0, "Not supplied").otherwise(F.array_join(F.transform("k", lambda x: F.concat(F.lit("- "), x.cast("string"))), "\n"))
    return by.select("c_custkey", F.concat_ws("\n", F.lit("Segment"), F.concat(F.lit("- "), F.col("c_mktsegment")), F.lit("Orders"), lines).alias("text"))


@query("p3_p4_pushed_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def pushed(spark, sf):
    return t(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


@query("p5_p9_violations", """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice < 1000 THEN 'price' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') THEN 'priority' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def violations(spark, sf):
    rules = {"price": F.col("o_totalprice") >= 1000, "priority": F.col("o_orderpriority").rlike("^[1-5]-[A-Z ]+$"), "status": F.col("o_orderstatus").isin("F", "O")}
    return co.violations(t(spark, sf, "orders"), rules, ["o_orderkey"])


@query("p16_p17_gate_with_reason", """SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'title_match' WHEN (p_brand = 'Brand#1')::INT + (p_type = 'ECONOMY')::INT + (p_size > 25)::INT >= 2 THEN 'body_matches' ELSE 'insufficient' END AS reason FROM part""")
def gate(spark, sf):
    body = (F.col("p_brand") == "Brand#1").cast("int") + (F.col("p_type") == "ECONOMY").cast("int") + (F.col("p_size") > 25).cast("int")
    return t(spark, sf, "part").select("p_partkey", F.when(F.col("p_name").contains("ring"), "title_match").when(body >= 2, "body_matches").otherwise("insufficient").alias("reason"))


@query("p21_byte_budget", "SELECT lang, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, sum(strlen(text)) > 90000 OR count(*) > 1000 AS over FROM documents GROUP BY lang")
def byte_budget(spark, sf):
    by = t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"))
    return by.withColumn("over", (F.col("bytes") > 90000) | (F.col("docs") > 1000))


@query("p22_literal_support", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'FURNITURE') OR contains(c_name, '00001') AS supported FROM customer")
def literal_support(spark, sf):
    quote = F.when(F.col("c_name").contains("00001"), F.lit("00001")).otherwise(F.col("c_mktsegment"))
    return t(spark, sf, "customer").select("c_custkey", ev.supported(quote, F.array(F.lit("BUILDING"), F.lit("FURNITURE")), F.array("c_name")).alias("supported"))


@query("p23_json_leaf", "SELECT event_id, props::JSON->>'k' AS leaf, contains(props, props::JSON->>'k') AS holds FROM events")
def json_leaf(spark, sf):
    leaf = F.get_json_object("props", "$.k")
    return t(spark, sf, "events").select("event_id", leaf.alias("leaf"), F.col("props").contains(leaf).alias("holds"))


@query("j1_dimension_decode", """SELECT l_orderkey, l_linenumber, p_brand, CASE WHEN p_partkey IS NULL THEN 'unknown_code' END AS fault FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 3""")
def dimension_decode(spark, sf):
    dim = t(spark, sf, "part").filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.lit(True).alias("known"))
    return t(spark, sf, "lineitem").join(dim, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_brand", F.when(F.col("known").isNull(), "unknown_code").alias("fault"))


@query("j1_case_decode", """SELECT c_custkey::VARCHAR AS case_id, pos, code, CASE code WHEN 'E_1' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END WHEN 'E_3' THEN (c_custkey % 11)::VARCHAR ELSE CASE c_custkey % 2 WHEN 0 THEN 'head' ELSE 'chest' END END AS answer, NULL::VARCHAR AS fault
 FROM customer, (VALUES (0, 'E_1'), (1, 'E_3'), (2, 'E_4')) v(pos, code)""")
def case_decode(spark, sf):
    k = F.col("c_custkey")
    dim = spark.createDataFrame([("E_1", "Fever?", "B", False), ("E_3", "How bad?", "C", False), ("E_4", "Where?", "M", True)], "code string, question string, data_type string, is_antecedent boolean")
    values = spark.createDataFrame([("E_4", "V_1", "head"), ("E_4", "V_2", "chest")], "code string, raw string, meaning string")
    text = F.concat(F.lit("['E_1_@_"), F.when(k % 2 == 0, "1").otherwise("0"), F.lit("', 'E_3_@_"), (k % 11).cast("string"), F.lit("', 'E_4_@_"), F.when(k % 2 == 0, "V_1").otherwise("V_2"), F.lit("']"))
    cases = t(spark, sf, "customer").select(k.cast("string").alias("case_id"), cs.listed(text).alias("evidences"))
    return cs.decode(cases, dim, values).select("case_id", "pos", "code", "answer", "fault")


@query("j2_code_or_name", "WITH x AS (SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN s_nationkey::VARCHAR ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) END AS ref, s_nationkey FROM supplier) SELECT s_suppkey, n_name AS name FROM x JOIN nation ON n_nationkey = s_nationkey")
def code_or_name(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    s = t(spark, sf, "supplier").withColumn("code", F.col("s_nationkey").cast("string")).join(n, "code")
    return cs.resolve(s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("code")).otherwise(F.col("name")).alias("ref")), n, "ref").select("s_suppkey", "name")


@query("j3_j12_reconciliation", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN b.o_orderkey IS NULL THEN 'unexpected' WHEN a.d <> b.d THEN 'changed' ELSE 'same' END AS status FROM (SELECT o_orderkey, o_orderstatus AS d FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 11 <> 0) b USING (o_orderkey)")
def reconciliation(spark, sf):
    o = t(spark, sf, "orders")
    a = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("d"))
    b = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("d"))
    return co.reconcile(a, b, "o_orderkey", "d")


@query("j7_interval_membership", "SELECT p_partkey, band FROM part JOIN (VALUES ('small', 0, 17), ('teen', 13, 17), ('mid', 18, 40), ('all', 0, 1000)) v(band, lo, hi) ON p_size BETWEEN lo AND hi")
def interval_membership(spark, sf):
    bands = spark.createDataFrame([("small", 0, 17), ("teen", 13, 17), ("mid", 18, 40), ("all", 0, 1000)], "band string, lo int, hi int")  # four stated rows
    return t(spark, sf, "part").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "band")


@query("j8_enclosing_section", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS pos FROM events WHERE event_type <> 'signup'), b AS (SELECT user_id, epoch_us(ts) AS s FROM events WHERE event_type = 'signup')
SELECT event_id, max(s) AS section_start FROM e LEFT JOIN b ON b.user_id = e.user_id AND s <= pos GROUP BY event_id""")
def enclosing_section(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    bounds = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("s"))
    return ev.enclosing(e.filter("event_type <> 'signup'"), bounds, "user_id", "at", "s").select("event_id", "section_start")


@query("j9_wanted_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def wanted(spark, sf):
    c = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j10_dangling_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)")
def dangling(spark, sf):
    allowed = t(spark, sf, "part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return co.dangling(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), allowed, ["l_partkey"])


@query("j11_o5_set_equality", "SELECT o_custkey AS k, 'left' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 13 <> 0) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 13 <> 0)")
def set_equality(spark, sf):
    a = t(spark, sf, "orders").filter("o_custkey % 13 <> 0").select(F.col("o_custkey").alias("k"))
    b = t(spark, sf, "customer").filter("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("k"))
    return co.set_difference(a, b, ["k"])


@query("o2_union_all", "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def union_all(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side"))
    return a.unionByName(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


@query("s9_o2_sorted_union_with_duplicates", "SELECT id, count(*) AS n FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey FROM supplier) GROUP BY id HAVING count(*) > 1")
def union_duplicates(spark, sf):
    both = t(spark, sf, "part").select(F.col("p_partkey").alias("id")).unionByName(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return co.repeated(both, ["id"])


@query("o3_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf, "supplier").select("s_nationkey"))


@query("o4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(t(spark, sf, "orders").select("o_custkey").distinct())


@query("a10_rejection_histogram", """WITH v AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderkey % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS rule FROM orders),
r AS (SELECT o_orderkey, string_agg(DISTINCT rule, ' + ' ORDER BY rule) AS reason FROM v GROUP BY 1) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def rejection_histogram(spark, sf):
    from siftstone.operators.evaluation import histogram

    rules = {"cheap": F.col("o_totalprice") >= 50000, "pending": F.col("o_orderstatus") != "P", "third": F.col("o_orderkey") % 3 != 0}
    return histogram(co.violations(t(spark, sf, "orders"), rules, ["o_orderkey"]), "o_orderkey", "rule")


@query("a13_a14_null_safe_ratios", "SELECT c_nationkey, round(count(*) FILTER (c_acctbal > 0)::DOUBLE / nullif(count(*) FILTER (c_mktsegment = 'BUILDING'), 0), 9) AS ratio FROM customer GROUP BY 1")
def ratios(spark, sf):
    from siftstone.operators.evaluation import ratio

    return t(spark, sf, "customer").groupBy("c_nationkey").agg(ratio(F.count_if(F.col("c_acctbal") > 0), F.count_if(F.col("c_mktsegment") == "BUILDING")).alias("ratio"))


@query("a20_availability", "SELECT c_custkey, CASE WHEN f AND o THEN 'BOTH' WHEN f THEN 'F_ONLY' WHEN o THEN 'O_ONLY' ELSE 'NONE' END AS available FROM (SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'F'), false) AS f, coalesce(bool_or(o_orderstatus = 'O'), false) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def available(spark, sf):
    has = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "O").alias("o"))
    j = t(spark, sf, "customer").join(has, "c_custkey", "left")
    no = F.lit(False)
    return j.select("c_custkey", ev.availability(F.coalesce("f", no), F.coalesce("o", no), "F", "O").alias("available"))


@query("a21_snapshot_hash", "SELECT o_custkey, count(*) AS n_rows, sha256(string_agg(o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority, chr(10) ORDER BY o_orderkey)) AS snapshot_id FROM orders GROUP BY 1")
def snapshot_hash(spark, sf):
    return ev.snapshot(t(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("a23_grouped_answers", "SELECT o_custkey, o_orderstatus, string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey) AS answers FROM orders GROUP BY 1, 2")
def grouped_answers(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return t(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_join(rows, " | ").alias("answers"))


@query("a25_report_counters", "SELECT count(*) AS discovered, count(*) FILTER (url LIKE 'https:%') AS secure, count(*) FILTER (url LIKE '%utm_%') AS tracked, count(DISTINCT url) AS distinct_urls FROM pages")
def report_counters(spark, sf):
    return t(spark, sf, "pages").agg(F.count("*").alias("discovered"), F.count_if(F.col("url").like("https:%")).alias("secure"), F.count_if(F.col("url").contains("utm_")).alias("tracked"), F.countDistinct("url").alias("distinct_urls"))


@query("a26_citation_usage", "SELECT o_custkey, len(list_distinct(list(l_partkey))) AS cited, len(list_filter(list_distinct(list(l_partkey)), lambda x: x % 2 = 0)) AS accepted FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def citation_usage(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    by = j.groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("c"))
    return by.select("o_custkey", F.size("c").cast("long").alias("cited"), F.size(F.filter("c", lambda x: x % 2 == 0)).cast("long").alias("accepted"))


@query("a27_merged_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def merged_totals(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("w8_multi_key_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, lower(p_name), p_type, p_brand, p_partkey) AS place FROM part QUALIFY place <= 100")
def multi_key(spark, sf):
    """A bounded report: the first hundred by a total order, taken before they are numbered."""
    top = t(spark, sf, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), F.lower("p_name"), "p_type", "p_brand", "p_partkey").limit(100)
    w = Window.orderBy(F.desc("p_size"), F.desc("p_retailprice"), F.lower("p_name"), "p_type", "p_brand", "p_partkey")
    return top.select("p_partkey", F.row_number().over(w).alias("place"))


@query("w19_rank_contiguity", "SELECT o_custkey, bool_and(r = n) AS contiguous FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def contiguity(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t(spark, sf, "orders").select("o_custkey", (F.row_number().over(w) == F.count("*").over(w)).alias("ok")).groupBy("o_custkey").agg(F.min("ok").alias("contiguous"))


@query("w21_first_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50")
def first_rows(spark, sf):
    return t(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("w22_bounded_list", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS shown FROM orders GROUP BY 1")
def bounded_list(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 3).cast("array<string>"), ",").alias("shown"))


@query("d2_d5_dates", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS days, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def dates(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("d4_partial_dates", "SELECT o_orderkey, concat_ws('-', year(o_orderdate)::VARCHAR, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate)::VARCHAR END, CASE WHEN o_orderkey % 3 > 1 THEN day(o_orderdate)::VARCHAR END) AS d FROM orders")
def partial_dates(spark, sf):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    return t(spark, sf, "orders").select("o_orderkey", F.concat_ws("-", F.year(d).cast("string"), F.when(k > 0, F.month(d).cast("string")), F.when(k > 1, F.dayofmonth(d).cast("string"))).alias("d"))


@query("r2_enumerated_refs", "SELECT 'patient:orders:' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS ref, o_custkey, o_orderkey FROM orders")
def enumerated(spark, sf):
    by = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return by.select("o_custkey", F.posexplode("k").alias("i", "o_orderkey")).select(F.concat(F.lit("patient:orders:"), F.col("i").cast("string")).alias("ref"), "o_custkey", "o_orderkey")


@query("r3_nested_flatten", "SELECT l_orderkey, l_partkey AS ref, 'part' AS path FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 'supplier' FROM lineitem")
def flattened(spark, sf):
    pairs = F.array(F.struct(F.col("l_partkey").alias("ref"), F.lit("part").alias("path")), F.struct(F.col("l_suppkey").alias("ref"), F.lit("supplier").alias("path")))
    return t(spark, sf, "lineitem").select("l_orderkey", F.explode(pairs).alias("x")).select("l_orderkey", "x.ref", "x.path")


@query("r4_map_without_keys", "SELECT c_custkey, 'segment=' || c_mktsegment AS kept FROM customer")
def map_filtered(spark, sf):
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("retrieved_at"), F.col("c_name"))
    kept = F.map_filter(m, lambda k, v: ~k.isin("retrieved_at", "raw_path"))
    return t(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


@query("r5_r6_regrouped", "SELECT o_custkey, array_to_string(coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), []), ',') AS finished, array_to_string(coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F'), []), ',') AS others FROM orders GROUP BY 1")
def regrouped(spark, sf):
    part = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("o_orderkey")))).cast("array<string>"), ",")
    is_ = F.col("o_orderstatus") == "F"
    return t(spark, sf, "orders").groupBy("o_custkey").agg(part(is_).alias("finished"), part(~is_).alias("others"))


@query("r7_r8_json_round_trip", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, true AS same FROM events")
def json_round_trip(spark, sf):
    parsed = F.from_json("props", "k bigint")
    again = F.from_json(F.to_json(parsed), "k bigint")
    return t(spark, sf, "events").select("event_id", parsed["k"].alias("k"), (parsed["k"] == again["k"]).alias("same"))


@query("m8_buckets", "SELECT p_partkey, p_size // 10 AS decade, CASE WHEN p_size < 18 THEN 'child' WHEN p_size < 65 THEN 'adult' ELSE 'older adult' END AS age_group FROM part")
def buckets(spark, sf):
    return t(spark, sf, "part").select("p_partkey", vec.decade(F.col("p_size")).alias("decade"), vec.age_group(F.col("p_size")).alias("age_group"))


@query("s14_skip_existing", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def skip_existing(spark, sf):
    p = t(spark, sf, "pages").select("url", "page_id")
    return p.join(p.filter("page_id % 3 = 0").select("url").distinct(), "url", "left_anti").select("url").distinct()


@query("s12_fill_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def fill_forward(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("s11_catalog_dedupe", "SELECT page_id, url FROM pages WHERE url LIKE 'http%' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def catalog_dedupe(spark, sf):
    return rk.first_of(t(spark, sf, "pages").filter(F.col("url").like("http%")).select("page_id", "url"), ["url"], [F.asc("page_id")])


@query("s17_row_hashes", "SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS digest FROM customer")
def row_hashes(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), 256).alias("digest"))


@query("e1_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    """An extension: the engine's own multi-level aggregation."""
    return t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))

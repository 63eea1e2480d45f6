"""Hits held against their contract: strict JSON shapes, identity, checksum, spans and gate; topics among hits; ranks of captured systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.constraints import checked, repeated, violations

#: Kinds of JSON values by the type of their VARIANT. No text is a number here, no number a text and no whole number a boolean.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}


def _fields(v: Column) -> Column:
    """The fields of an object; null for any other value."""
    return F.when(F.schema_of_variant(v).rlike("^OBJECT"), v.try_cast("map<string,variant>"))


def shape_faults(value: Column, shape: dict[str, str], at: str = "") -> Column:
    """An array of (path, fault) of a VARIANT: its fields are exactly those of shape, each of its kind. Kinds are joined by | where a field may have several.

    Faults: not_an_object, missing, unexpected, kind. Values are looked at as they were written and never converted.
    """
    have = _fields(value)
    item = lambda path, fault: F.struct(F.concat(F.lit(at + "/"), path).alias("path"), F.lit(fault).alias("fault"))
    one = lambda name, kinds: F.when(~F.map_contains_key(have, F.lit(name)), item(F.lit(name), "missing")).when(
        ~F.schema_of_variant(have[name]).rlike("|".join(_TYPES[k] for k in kinds.split("|"))), item(F.lit(name), "kind")
    )
    told = F.array_compact(F.array(*[one(n, k) for n, k in shape.items()]))
    more = F.transform(F.array_sort(F.array_except(F.map_keys(have), F.array(*map(F.lit, shape)))), lambda k: item(k, "unexpected"))
    return F.when(have.isNull(), F.array(item(F.lit(""), "not_an_object"))).otherwise(F.concat(told, more))


def strict_faults(df: DataFrame, key: str, json: str, shape: dict[str, str]) -> DataFrame:
    """key, path, fault for each place where a JSON text is not of a shape; a text that is no JSON, or null, has the fault not_json at the root."""
    v = F.try_parse_json(json)
    root = F.array(F.struct(F.lit("/").alias("path"), F.lit("not_json").alias("fault")))
    return df.select(key, F.explode(F.when(v.isNull(), root).otherwise(shape_faults(v, shape))).alias("f")).select(key, "f.path", "f.fault")


# The envelope of a hit, what it says of its source and of its retrieval.
ENVELOPE = {"chunk_id": "string", "document_id": "string", "source": "string", "title": "string", "url": "string", "text": "string", "metadata": "object", "retrieval": "object"}
METADATA = {"topic_id": "string", "parent_id": "string", "chunk": "integer", "title": "string", "url": "string", "chunk_sha256": "string", "content_sha256": "string", "tokens": "integer", "spans": "array"}
RETRIEVAL = {"distance": "number", "max_distance": "number", "metric": "string", "acceptance": "string", "snapshot": "string"}
_PARSED = """chunk_id string, document_id string, source string, title string, url string, text string,
metadata struct<topic_id string, parent_id string, chunk bigint, title string, url string, chunk_sha256 string, content_sha256 string, tokens bigint, spans array<struct<start bigint, `end` bigint, split boolean>>>,
retrieval struct<distance double, max_distance double, metric string, acceptance string, snapshot string>"""


def hit_rules(source: str, host: str, most_tokens: int = 256) -> dict[str, Column]:
    """Rules over the parsed struct `hit` and the text's VARIANT `v`; a rule that is null is broken."""
    h, m, r = F.col("hit"), F.col("hit.metadata"), F.col("hit.retrieval")
    none = lambda a: F.size(a) == 0
    part = lambda name: _fields(F.col("v"))[name]
    parent = F.concat(F.lit(source + ":topic:"), m["topic_id"])
    hexes = [m[c].rlike("^[0-9a-f]{64}$") for c in ("chunk_sha256", "content_sha256")]
    spans = F.coalesce(F.try_variant_get(F.col("v"), "$.metadata.spans", "array<variant>"), F.array().cast("array<variant>"))
    sound = none(F.flatten(F.transform(spans, lambda s: shape_faults(s, {"start": "integer", "end": "integer", "split": "boolean"}))))
    gated = (r["acceptance"] == "exact_source_lookup") | ((r["acceptance"] == "distance_gate") & (r["distance"] <= r["max_distance"]))
    return {
        "envelope": none(shape_faults(F.col("v"), ENVELOPE)), "metadata": none(shape_faults(part("metadata"), METADATA)), "retrieval": none(shape_faults(part("retrieval"), RETRIEVAL)) & (r["metric"] == "squared_l2") & r["snapshot"].rlike("^[0-9a-f]{24}$"),
        "identity": (h["source"] == source) & m["topic_id"].rlike("^[0-9]+$") & (h["document_id"] == parent) & (m["parent_id"] == parent) & (m["chunk"] >= 0) & (h["chunk_id"] == F.concat(parent, F.lit(":chunk:"), m["chunk"].cast("string"))),
        "binding": (h["title"] == m["title"]) & (h["url"] == m["url"]),
        "url": (F.try_parse_url(h["url"], F.lit("PROTOCOL")) == "https") & (F.try_parse_url(h["url"], F.lit("HOST")) == host) & F.try_parse_url(h["url"], F.lit("USERINFO")).isNull(),
        "checksum": (F.trim(h["text"]) != "") & (F.sha2(h["text"], 256) == m["chunk_sha256"]) & hexes[0] & hexes[1], "tokens": m["tokens"].between(1, most_tokens),
        "spans": (F.size(spans) > 0) & sound & F.forall(m["spans"], lambda s: (s["start"] >= 0) & (s["start"] < s["end"])),
        "distance": (r["distance"] >= 0) & (r["max_distance"] >= 0) & (r["distance"] < float("inf")) & (r["max_distance"] < float("inf")), "gate": gated,
    }


def _read(hits: DataFrame, json: str) -> DataFrame:
    return hits.withColumn("v", F.try_parse_json(json)).withColumn("hit", F.from_json(json, _PARSED))


def hit_faults(hits: DataFrame, key: str, json: str, source: str, host: str) -> DataFrame:
    """key, rule for every rule that a hit's JSON breaks; what is no JSON breaks all."""
    return violations(_read(hits, json), hit_rules(source, host), [key])


def valid_hits(hits: DataFrame, key: str, json: str, source: str, host: str) -> DataFrame:
    """key, hit (the parsed struct); reading it fails at the first hit that breaks a rule, so no rejected candidate becomes evidence."""
    return checked(_read(hits, json), hit_rules(source, host)).select(key, "hit")


def topic_hits(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hits, whole, title_match, definition_match, passed for each query of expected.

    hits: query_id, title, section, text, provenance, licence. expected: query_id, titles. A hit answers by its document's title, or by a section that is headed
    `What is` or `What are` and one of the titles. A query passes where some hit answers and all have text, provenance and licence; one without hits fails.
    """
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    by_title = F.array_contains("titles", F.col("title"))
    headed = F.exists("titles", lambda x: F.lower("section").isin(F.concat(F.lit("what is "), F.lower(x), F.lit("?")), F.concat(F.lit("what are "), F.lower(x), F.lit("?"))))
    there = F.col("__there").isNotNull()
    met = expected.join(hits.withColumn("__there", F.lit(True)), "query_id", "left")
    told = met.select("query_id", there.alias("there"), *[(there & F.coalesce(c, F.lit(False))).alias(n) for n, c in (("t", by_title), ("d", ~F.coalesce(by_title, F.lit(False)) & headed), ("w", filled("text") & filled("provenance") & filled("licence")))])
    by = told.groupBy("query_id").agg(F.count_if("there").alias("hits"), F.min("w").alias("whole"), F.max("t").alias("title_match"), F.max("d").alias("definition_match"))
    return by.select("*", (F.col("whole") & (F.col("title_match") | F.col("definition_match"))).alias("passed"))


def rank_faults(rankings: DataFrame, systems: DataFrame) -> DataFrame:
    """pool_id, system, fault: captured rankings whose ranks are not 1 to their stated number, each candidate once, within their depth, or that changed what their parent said.

    rankings: pool_id, system, candidate_id, rank, original_rank, score. systems: pool_id, system, returned, depth, parent (null for none). A system with a parent
    reorders the parent's candidates: each must be there with the original rank and score. No ranking is sorted or gathered; counts, extremes and one join tell.
    """
    key = ["pool_id", "system"]
    twice = repeated(rankings, [*key, "candidate_id"]).groupBy(*key).agg(F.lit(True).alias("twice"))
    same_rank = repeated(rankings, [*key, "rank"]).groupBy(*key).agg(F.lit(True).alias("same_rank"))
    by = rankings.groupBy(*key).agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    parents = rankings.select("pool_id", F.col("system").alias("parent"), "candidate_id", F.col("rank").alias("__rank"), F.col("score").alias("__score"))
    child = rankings.join(systems.filter("parent is not null").select(*key, "parent"), key)
    changed = child.join(parents, ["pool_id", "parent", "candidate_id"], "left").filter(~(F.col("original_rank").eqNullSafe(F.col("__rank")) & F.col("score").eqNullSafe(F.col("__score")))).select(*key).distinct().withColumn("changed", F.lit(True))
    all_ = systems.join(by, key, "left").join(twice, key, "left").join(same_rank, key, "left").join(changed, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = {
        "count": F.col("n") == F.col("returned"), "depth": F.col("returned") <= F.col("depth"), "candidates": F.col("twice").isNull(),
        "ranks": (F.col("n") == 0) | (F.col("same_rank").isNull() & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))), "parent": F.col("changed").isNull(),
    }
    return violations(all_, rules, key).withColumnRenamed("rule", "fault")

"""Audits: two independent sides of the same facts, compared; what differs comes out as rows, and nothing is repaired.

Each check reads stored rows on one side and rebuilds them from their sources on the other. A check of a whole gives
counters and a list of faults, and has passed only if the list is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.functions import vectors as vec
from siftstone.operators.documents import VERSION
from siftstone.operators.evidence import span_text


def chunk_id(key: Column, index: Column, text: Column) -> Column:
    """The id that a chunk's document, place and text determine."""
    return ids.uuid5(F.concat_ws("/", F.lit("medical-knowledge"), key.cast("string"), F.lit(VERSION), index.cast("string"), ids.digest(text)))


def index_faults(stored: DataFrame, expected: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """chunk_id, fault: what a stored index has against its sources.

    stored: doc_id, chunk_index, chunk_id, text, url; expected: doc_id, chunk_index, chunk_id, text, as rebuilt from the sources;
    vectors: chunk_id, embedding. A chunk may have several faults; a chunk that is not stored has one.
    """
    twice = stored.groupBy("chunk_id").agg(F.count("*").alias("__n"))
    built = expected.select("chunk_id", F.struct("doc_id", "chunk_index", "text").alias("__e"))
    v = vectors.select("chunk_id", F.col("embedding").alias("__v"))
    rows = stored.join(twice, "chunk_id").join(built, "chunk_id", "left").join(v, "chunk_id", "left")
    same = F.col("__e").eqNullSafe(F.struct("doc_id", "chunk_index", "text"))
    sound = F.coalesce(vec.well_formed(F.col("__v"), size) & vec.unit_length(F.col("__v")), F.lit(False))
    rules = {
        "duplicate_id": F.col("__n") > 1,
        "empty_chunk": F.coalesce(F.trim("text"), F.lit("")) == "",
        "wrong_id": F.col("chunk_id") != chunk_id(F.col("doc_id"), F.col("chunk_index"), F.coalesce("text", F.lit(""))),
        "unknown_to_source": F.col("__e").isNull(),
        "differs_from_source": F.col("__e").isNotNull() & ~same,
        "missing_provenance": F.coalesce(F.col("url"), F.lit("")) == "",
        "missing_vector": F.col("__v").isNull(),
        "invalid_vector": F.col("__v").isNotNull() & ~sound,
    }
    told = rows.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))).alias("fault"))
    lost = expected.select("chunk_id").join(stored.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("not_stored").alias("fault"))
    return told.unionByName(lost)


#: What index_faults() can tell, in the order of a report.
INDEX_FAULTS = ("duplicate_id", "empty_chunk", "wrong_id", "unknown_to_source", "differs_from_source", "missing_provenance", "missing_vector", "invalid_vector", "not_stored")


def index_audit(stored: DataFrame, faults: DataFrame) -> DataFrame:
    """One row: documents, chunks, suppressed repeats of a text, a counter for each kind of fault, and passed."""
    whole = stored.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), (F.count("*") - F.countDistinct("text")).alias("duplicate_chunks"))
    counted = faults.agg(*[F.count_if(F.col("fault") == k).alias(k) for k in INDEX_FAULTS], (F.count("*") == 0).alias("clean"))
    return whole.crossJoin(F.broadcast(counted)).withColumn("passed", F.col("clean") & (F.col("duplicate_chunks") == 0)).drop("clean")  # one row each


def collections(named: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """collection, present, n: exact counts; a collection that is not there has none."""
    spark = next(df for _, df in named if df is not None).sparkSession
    out = None
    for name, df in named:
        row = df.agg(F.lit(name).alias("collection"), F.lit(True).alias("present"), F.count("*").alias("n")) if df is not None else spark.range(1).select(F.lit(name).alias("collection"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def replay(stored: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """key, field, fault: rows on one side alone, and values that differ by more than the tolerance; a null differs from a value."""
    a = stored.select(*key, F.struct(*columns).alias("__a"))
    b = recomputed.select(*key, F.struct(*columns).alias("__b"))
    both = a.join(b, key, "full")
    one = F.when(F.col("__a").isNull(), F.struct(F.lit("row").alias("field"), F.lit("not_stored").alias("fault"))).when(F.col("__b").isNull(), F.struct(F.lit("row").alias("field"), F.lit("not_reproduced").alias("fault")))
    each = [
        F.when(
            F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.coalesce(F.abs(F.col(f"__a.{c}") - F.col(f"__b.{c}")) <= tolerance, F.col(f"__a.{c}").isNull() & F.col(f"__b.{c}").isNull()),
            F.struct(F.lit(c).alias("field"), F.lit("value").alias("fault")),
        )
        for c in columns
    ]
    return both.select(*key, F.explode(F.array_compact(F.array(one, *each))).alias("f")).select(*key, "f.field", "f.fault")


def controls(saved: DataFrame, fresh: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """run, exact: whether a run's saved rows are just the fresh ones, as multisets; runs of either side."""
    cols = [run, *columns]
    odd = saved.select(*cols).exceptAll(fresh.select(*cols)).select(run).union(fresh.select(*cols).exceptAll(saved.select(*cols)).select(run)).distinct()
    every = saved.select(run).union(fresh.select(run)).distinct()
    return every.join(odd.withColumn("__odd", F.lit(True)), run, "left").select(run, F.col("__odd").isNull().alias("exact"))


def span_faults(spans: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, start, end, fault: spans (key, start, end, quoted) whose source (key, text) is missing, too short, or says something else there."""
    met = spans.join(sources.select(key, F.col("text").alias("__t")), key, "left")
    fault = (
        F.when(F.col("__t").isNull(), "no_source")
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("__t")), "out_of_range")
        .when(span_text(F.col("__t"), F.col("start"), F.col("end")) != F.col("quoted"), "altered")
    )
    return met.select(key, "start", "end", fault.alias("fault")).filter("fault is not null")


def accounting(requests: DataFrame, handed: DataFrame, key: str) -> DataFrame:
    """key, requests, handed, equal: requests counted on one side, told by the other (key, requests); a side without a row has 0."""
    a = requests.groupBy(key).agg(F.count("*").alias("requests"))
    b = handed.select(key, F.col("requests").alias("handed"))
    both = a.join(b, key, "full").select(key, F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("handed", F.lit(0)).alias("handed"))
    return both.withColumn("equal", F.col("requests") == F.col("handed"))


def leakage(hits: DataFrame, index: DataFrame, queries: DataFrame, k: int, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """query, hits, leaked, complete: hits whose split is not train, and whether there are min(k, size of the index) of them."""
    size = index.agg(F.count("*").alias("__n"))
    met = hits.join(index.select(item, "split"), item).groupBy(query).agg(F.count("*").alias("__h"), F.count_if(F.col("split") != "train").alias("__l"))
    told = queries.select(query).join(met, query, "left").crossJoin(F.broadcast(size))  # one row
    n = F.coalesce("__h", F.lit(0))
    return told.select(query, n.alias("hits"), F.coalesce("__l", F.lit(0)).alias("leaked"), (n == F.least(F.lit(k), F.col("__n"))).alias("complete"))


def observed(stages: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """key, stage, status of stage rows (key, stage, failed): FAIL if a row failed, SKIPPED if there is none, else PASS."""
    spark = stages.sparkSession
    every = stages.select(key).distinct().crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in wanted], "stage string")))  # the stated stages
    seen = stages.groupBy(key, "stage").agg(F.max("failed").alias("__f"))
    return every.join(seen, [key, "stage"], "left").select(key, "stage", F.when(F.col("__f"), "FAIL").when(F.col("__f").isNull(), "SKIPPED").otherwise("PASS").alias("status"))


def selection_faults(chosen: DataFrame, catalog: DataFrame, case: str, item: str, most: int = 3) -> DataFrame:
    """case, fault: unknown ids, repeated ids, and more than `most` of them."""
    known = catalog.select(item).distinct().withColumn("__k", F.lit(True))
    by = chosen.join(known, item, "left").groupBy(case).agg(F.count("*").alias("n"), F.countDistinct(item).alias("d"), F.count_if(F.col("__k").isNull()).alias("u"))
    faults = F.array_compact(F.array(F.when(F.col("u") > 0, "unknown"), F.when(F.col("n") > F.col("d"), "repeated"), F.when(F.col("n") > most, "too_many")))
    return by.select(case, F.explode(faults).alias("fault"))


def verdict_faults(verdicts: DataFrame, key: str, least: int = 4, most: int = 600) -> DataFrame:
    """key, fault of review verdicts (key, supported, quotes): support if and only if quotes, of 4 to 600 characters, all different."""
    q = F.coalesce("quotes", F.array().cast("array<string>"))
    faults = F.array_compact(F.array(
        F.when(F.col("supported") & (F.size(q) == 0), "support_without_quote"),
        F.when(~F.col("supported") & (F.size(q) > 0), "quote_without_support"),
        F.when(F.exists(q, lambda x: (F.length(x) < least) | (F.length(x) > most)), "quote_length"),
        F.when(F.size(F.array_distinct(q)) < F.size(q), "quote_repeated"),
    ))
    return verdicts.select(key, F.explode(faults).alias("fault"))


def assessment_faults(assessments: DataFrame, key: list[str]) -> DataFrame:
    """key, fault of category assessments (result, findings): a clean one has no findings, an identified issue has some, at most 20."""
    n = F.size(F.coalesce("findings", F.array().cast("array<string>")))
    fault = F.when((F.col("result") == "no_issue_identified") & (n > 0), "clean_with_findings").when((F.col("result") == "issue_identified") & (n == 0), "issue_without_finding").when(n > 20, "too_many").when(
        ~F.col("result").isin("no_issue_identified", "issue_identified", "uncertain"), "unknown_result"
    )
    return assessments.select(*key, fault.alias("fault")).filter("fault is not null")


def provenance_faults(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """path, fault: files (path, sha256) against the hashes recorded beside them (path, sha256)."""
    both = files.select("path", F.col("sha256").alias("__a")).join(recorded.select("path", F.col("sha256").alias("__b")), "path", "full")
    fault = F.when(F.col("__b").isNull(), "no_record").when(F.col("__a").isNull(), "no_file").when(F.col("__a") != F.col("__b"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault is not null")


def over_budget(pairs: DataFrame, key: list[str], tokens: Column, most: int = 512) -> DataFrame:
    """key, tokens of the pairs that would be cut: none may be there before scoring begins."""
    return pairs.select(*key, tokens.alias("tokens")).filter(F.col("tokens") > most)


def baseline_control(reference: DataFrame, fresh: DataFrame, key: list[str], score: str, chosen: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: same_pairs, drift, flips, same_selection, passed for two scorings (key, score, chosen) of the same pairs."""
    a, b = reference.select(*key, F.struct(score, chosen).alias("__a")), fresh.select(*key, F.struct(score, chosen).alias("__b"))
    x, y = F.col(f"__a.{score}"), F.col(f"__b.{score}")
    met = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    told = a.join(b, key, "full").agg(
        F.min(met).alias("same_pairs"), F.round(F.max(F.abs(x - y)), 9).alias("drift"), F.count_if((x > 0) != (y > 0)).alias("flips"),
        F.coalesce(F.min(F.when(met, F.col(f"__a.{chosen}") == F.col(f"__b.{chosen}"))), F.lit(False)).alias("same_selection"),
    )
    return told.withColumn("passed", F.col("same_pairs") & (F.col("drift") <= tolerance) & (F.col("flips") == 0) & F.col("same_selection"))


def adapted_faults(audit: DataFrame, key: str) -> DataFrame:
    """key, fault of saved candidates (key, place, rank, text, text_sha, score, eligible): order, hash, finite score, eligibility."""
    faults = F.array_compact(F.array(
        F.when(F.col("rank") != F.col("place"), "order"),
        F.when(ids.digest(F.col("text")) != F.col("text_sha"), "hash"),
        F.when(F.isnan("score") | (F.abs("score") == float("inf")), "not_finite"),
        F.when(F.col("eligible") != (F.col("score") > 0), "eligibility"),
    ))
    return audit.select(key, F.explode(faults).alias("fault"))


def frozen_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field: where two conditions that share their frozen inputs do not: a row of one side alone, or a column that differs."""
    both = a.select(key, F.struct(*columns).alias("__a")).join(b.select(key, F.struct(*columns).alias("__b")), key, "full")
    alone = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("row"))
    each = [F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in columns]
    return both.select(key, F.explode(F.array_compact(F.array(alone, *each))).alias("field"))


# What a selection manifest must say of each document, and formats.
MANIFEST = ("id", "title", "url", "download_url", "sha256", "license_url", "license_evidence", "reviewed_by", "terms_url", "format")
FORMATS = ("pdf", "txt")


def manifest_faults(manifest: DataFrame, hosts: list[str]) -> DataFrame:
    """id, fault of a selection manifest (MANIFEST): blank fields, licences that are not open, other hosts, other formats."""
    from siftstone.functions.urls import host, open_licence

    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"blank_{c}")) for c in MANIFEST if c != "id"]
    official = lambda c: F.col(c).startswith("https://") & host(F.col(c)).isin(hosts)
    odd = [F.when(~F.coalesce(official(c), F.lit(False)), F.lit(f"host_{c}")) for c in ("url", "download_url", "terms_url")]
    more = [F.when(open_licence(F.col("license_url")).isNull(), F.lit("licence")), F.when(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False)), F.lit("format"))]
    return manifest.select("id", F.explode(F.array_compact(F.array(*blank, *odd, *more))).alias("fault"))


def reviewed_documents(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """id, text, fault of reviewed documents: the pinned hash must be that of the bytes, and the licence evidence must stand in the text.

    manifest: id, sha256, license_evidence; files: id, content (UTF-8 bytes). Rows with a fault have no text.
    """
    from siftstone.functions.text import clean

    met = manifest.select("id", "sha256", "license_evidence").join(files.select("id", "content"), "id", "left")
    text = clean(F.col("content").cast("string"))
    has = F.lower(text).contains(F.lower(clean(F.col("license_evidence"))))
    fault = F.when(F.col("content").isNull(), "no_file").when(F.sha2("content", 256) != F.col("sha256"), "bytes").when(~has, "evidence")
    return met.select("id", F.when(fault.isNull(), text).alias("text"), fault.alias("fault"))


def duplicate_evidence(evidence: DataFrame, case: str, kind: str, source: str) -> DataFrame:
    """case, kind, source of evidence that a safety input names more than once."""
    return evidence.groupBy(case, kind, source).agg(F.count("*").alias("n")).filter("n > 1").drop("n")


def round_trip(evidence: DataFrame, key: list[str], text: str, score: str, metadata: str) -> DataFrame:
    """key, holds: whether evidence is what its own metadata (a JSON text with id, sha, score) rebuilds."""
    told = F.from_json(metadata, "id string, sha string, score double")
    same = (told["id"] == F.concat_ws(":", *key)) & (told["sha"] == ids.digest(F.col(text))) & (told["score"] == F.col(score))
    return evidence.select(*key, F.coalesce(same, F.lit(False)).alias("holds"))


def envelope_text(envelope: Column, most: int = 2_000_000) -> tuple[Column, Column]:
    """(text, failure) of a typed answer envelope in JSON: the joined output texts of a completed answer, or why there is none."""
    shape = "status string, error string, output array<struct<type: string, role: string, status: string, content: array<struct<type: string, text: string>>>>"
    e = F.from_json(envelope, shape)
    said = F.filter(e["output"], lambda x: ~x["type"].eqNullSafe("reasoning"))
    parts = F.flatten(F.transform(said, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type: string, text: string>>"))))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    good = F.forall(said, lambda x: x["type"].eqNullSafe("message") & x["role"].eqNullSafe("assistant") & x["status"].eqNullSafe("completed") & x["content"].isNotNull())
    typed = F.forall(parts, lambda p: p["type"].eqNullSafe("output_text") & p["text"].isNotNull())
    failure = (
        F.when(e["status"].eqNullSafe("incomplete"), "incomplete_output")
        .when(~e["status"].eqNullSafe("completed") | e["error"].isNotNull() | e["output"].isNull() | (F.size(e["output"]) == 0) | ~good, "provider_failure")
        .when(F.exists(parts, lambda p: p["type"].eqNullSafe("refusal")), "refusal")
        .when(~typed | (F.trim(text) == "") | (F.octet_length(text) > most), "provider_failure")
    )
    return F.when(failure.isNull(), text), failure

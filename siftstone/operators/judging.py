"""Judged pools and reviewed selections: summaries of reviews, reviews held against what they judged, proposals that reviews confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.operators.constraints import checked, violations
from siftstone.operators.evaluation import DEPTHS, merged_counters, ratio
from siftstone.operators.evidence import supported

JUDGMENTS = ("relevant", "partially_relevant", "not_relevant", "uncertain")
#: What counts as found in each reading of the judgments.
POSITIVE = {"strict": ("relevant",), "inclusive": ("relevant", "partially_relevant")}


def review_status(candidates: DataFrame) -> DataFrame:
    """pool_id, candidates, reviewed, a count for each judgment, complete, status.

    candidates: pool_id, candidate_id, relevance (null where nobody has judged). A review is complete where every candidate has a judgment
    and none is uncertain; measures of any other are provisional, and a pool without a judgment has none.
    """
    by = candidates.groupBy("pool_id").agg(F.count("*").alias("candidates"), F.count("relevance").alias("reviewed"), *[F.count_if(F.col("relevance") == j).alias(j) for j in JUDGMENTS])
    complete = (F.col("reviewed") == F.col("candidates")) & (F.col("uncertain") == 0)
    status = F.when(F.col("reviewed") == 0, "withheld").when(complete, "complete").otherwise("provisional")
    return by.select("*", complete.alias("complete"), status.alias("status"))


def pool_metrics(candidates: DataFrame, rankings: DataFrame, systems: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """pool_id, mode, system, k, cutoff, positives, recall, mrr for each pool with a judgment.

    rankings: pool_id, candidate_id, system, rank. systems: pool_id, system, depth, the depth to which it was captured: beyond it nothing is
    inferred, so the cutoff of k is the lesser of both. Candidates without a judgment, and uncertain ones, are left out and never
    misses; without a positive, recall and mrr are null. Positives meet rankings by candidate, and only counts and least ranks go on.
    """
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(F.col("relevance").isin(*ok), F.lit(False)).alias("hit")) for m, ok in POSITIVE.items()])
    judged = candidates.select("pool_id", "candidate_id", F.col("relevance").isNotNull().alias("seen"), F.inline(modes))
    totals = judged.groupBy("pool_id", "mode").agg(F.count_if("hit").alias("positives"), F.max("seen").alias("seen")).filter("seen").drop("seen")
    met = judged.filter("hit").select("pool_id", "candidate_id", "mode").join(rankings, ["pool_id", "candidate_id"]).join(systems, ["pool_id", "system"])
    within = [F.count_if(F.col("rank") <= F.least(F.lit(k), F.col("depth"))).alias(f"h{k}") for k in depths]
    found = met.groupBy("pool_id", "mode", "system").agg(*within, F.min("rank").alias("best"))
    every = totals.join(systems, "pool_id").join(found, ["pool_id", "mode", "system"], "left")
    at = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.lit(k), F.col("depth")).cast("int").alias("cutoff"), F.coalesce(f"h{k}", F.lit(0)).alias("h")) for k in depths])
    mrr = F.when(F.col("positives") > 0, F.coalesce(F.round(1.0 / F.col("best"), 9), F.lit(0.0)))
    return every.select("pool_id", "mode", "system", "positives", mrr.alias("mrr"), F.inline(at)).select("pool_id", "mode", "system", "k", "cutoff", "positives", ratio(F.col("h"), F.col("positives")).alias("recall"), "mrr")


def depth_topics(ranked: DataFrame, by: list[str], title: str, topics: list[str], retained: Column, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """by, depth, returned, retained, and for each topic the ranks of titles that hold it, from one ranking and no search for each depth.

    ranked: by, rank, title and what retained reads, to the greatest depth; so the ranks of a topic are at most as many.
    """
    names = [c for c in (*by, "rank")]
    told = ranked.select(*names, F.coalesce(retained, F.lit(False)).alias("__kept"), *[F.lower(title).contains(x.lower()).alias(f"__{i}") for i, x in enumerate(topics)])
    each = told.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).filter("rank <= depth")
    probes = F.map_from_arrays(F.array(*map(F.lit, topics)), F.array(*[F.array_sort(F.collect_list(F.when(F.col(f"__{i}"), F.col("rank")))) for i, _ in enumerate(topics)]))
    return each.groupBy(*by, "depth").agg(F.count("*").alias("returned"), F.count_if("__kept").alias("retained"), probes.alias("topic_ranks"))


KINDS = ("A", "B", "C")
NEWLY = "nonpositive_to_positive"
_PAIR = ["pool_id", "candidate_id", "role"]


def _beside(analysis: DataFrame, reviews: DataFrame) -> DataFrame:
    told = analysis.select(*_PAIR, F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in ("eligible", "score", "query", "sha")], "selected", "counterfactual", "rule", "counterfactual_rule")
    return reviews.filter(F.col("transition") == NEWLY).join(told, _PAIR, "left")


def _guards() -> dict[str, Column]:
    there, same = F.col("__there").isNotNull(), lambda c: ~there | F.col(c).eqNullSafe(F.col(f"__{c}"))
    return {"unknown_pair": there, "kind": F.col("kind").isin(*KINDS), "not_eligible": ~there | F.col("__eligible"), "score": same("score"), "query": same("query"), "sha": same("sha")}


def review_faults(analysis: DataFrame, reviews: DataFrame) -> DataFrame:
    """pool_id, candidate_id, role, rule: reviews of newly eligible pairs that do not speak of what was analysed.

    analysis: pool_id, candidate_id, role, eligible, score, query, sha (of the evidence), selected, counterfactual, rule and counterfactual_rule (why
    not). reviews: pool_id, candidate_id, role, kind, score, query, sha, transition.
    """
    return violations(_beside(analysis, reviews), _guards(), _PAIR)


def reviewed_pairs(analysis: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of newly eligible pairs with what became of the pair; reading it fails at the first review with a fault.

    The selection was made before and is only read: no review has a say in it.
    """
    return checked(_beside(analysis, reviews), _guards()).select(*_PAIR, "kind", "selected", "counterfactual", F.when(~F.col("selected"), F.col("rule")).alias("rule"), F.when(~F.col("counterfactual"), F.col("counterfactual_rule")).alias("counterfactual_rule"))


def kind_counts(pairs: DataFrame) -> DataFrame:
    """pool_id, kind, pairs, selected, not_selected, counterfactual, newly, rejections (counters of rules, as selected and in the counterfactual); every kind of each pool, zeros included."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.col(c), F.lit(1).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>"))
    counters = pairs.withColumn("rejections", F.create_map(F.lit("selection"), one("rule"), F.lit("counterfactual"), one("counterfactual_rule")))
    merged = merged_counters(counters, ["pool_id", "kind"], "rejections")
    by = pairs.groupBy("pool_id", "kind").agg(
        F.count("*").alias("pairs"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("not_selected"), F.count_if("counterfactual").alias("counterfactual"),
        F.count_if(F.col("counterfactual") & ~F.col("selected")).alias("newly"),
    )
    every = pairs.select("pool_id").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    counts = ["pairs", "selected", "not_selected", "counterfactual", "newly"]
    return every.join(by, ["pool_id", "kind"], "left").join(merged, ["pool_id", "kind"], "left").select("pool_id", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "rejections")


def verified_selection(proposals: DataFrame, responses: DataFrame, catalog: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """case_id, status, selected, reviewed: what a selector proposed and reviews of the whole documents confirm, or nothing.

    proposals: case_id, ids (in order; null where the selector failed). responses: case_id, document_id, verdict (null where the review failed), fact_quotes,
    content_quotes. catalog: document_id, text of four header lines and a body. facts: case_id, rendered, literals (arrays).
    All ids are checked before a document is read: known, not repeated, at most `most`; else invalid_selection. Documents are
    reviewed in order. The first review that fails (content_review_failure) or quotes what neither the case nor the body holds
    (content_contract_failure) withholds the whole selection and ends the reviews; nothing is filled up. no_selection is no failure.
    """
    asked = proposals.select("case_id", F.posexplode("ids").alias("at", "document_id"))
    body = F.coalesce(F.get(F.split("text", "\n", 5), F.lit(4)), F.lit(""))
    none = F.array().cast("array<string>")
    quotes = lambda c: F.coalesce(F.col(c), none)
    read = asked.join(catalog.select("document_id", "text"), "document_id", "left").join(responses, ["case_id", "document_id"], "left").join(facts, "case_id", "left")
    facts_held = F.forall(quotes("fact_quotes"), lambda q: supported(q, quotes("rendered"), quotes("literals")))
    outcome = (
        F.when(F.col("text").isNull(), "unknown").when(F.col("verdict").isNull(), "failed")
        .when(~facts_held | ~F.forall(quotes("content_quotes"), lambda q: F.contains(body, q)), "unsupported").otherwise(F.col("verdict"))
    )
    by = read.select("case_id", F.struct("at", "document_id", outcome.alias("outcome")).alias("r")).groupBy("case_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    told = proposals.join(by, "case_id", "left").withColumn("r", F.coalesce("r", F.array().cast(by.schema["r"].dataType)))
    ids = F.transform("r", lambda x: x["document_id"])
    bad = F.filter("r", lambda x: x["outcome"].isin("failed", "unsupported"))
    chosen = F.transform(F.filter("r", lambda x: x["outcome"] == "relevant"), lambda x: x["document_id"])
    invalid = (F.size("r") > most) | (F.size(F.array_distinct(ids)) < F.size("r")) | F.exists("r", lambda x: x["outcome"] == "unknown")
    status = (
        F.when(F.col("ids").isNull(), "selector_failure").when(invalid, "invalid_selection")
        .when(F.get(bad, F.lit(0))["outcome"] == "failed", "content_review_failure").when(F.size(bad) > 0, "content_contract_failure")
        .when(F.size(chosen) > 0, "selected_and_verified").otherwise("no_selection")
    )
    reviewed = F.when(F.col("ids").isNull() | invalid, F.lit(0)).when(F.size(bad) > 0, F.get(bad, F.lit(0))["at"] + 1).otherwise(F.size("r"))
    return told.select("case_id", status.alias("status"), F.when(status == "selected_and_verified", chosen).otherwise(F.slice(chosen, 1, 0)).alias("selected"), reviewed.cast("int").alias("reviewed"))


# The two templates, the phrases of the populations and the two prefixes.
CURRENT = "The patient's current reported findings are %s. What medical information is relevant to these current findings?"
BACKGROUND = "The reported historical or background information%s is %s. What medical information is relevant to this history?"
POPULATIONS = {"child": " for a child", "adult": " for an adult", "older adult": " for an older adult", "": ""}
PREFIXES = {"symptoms": "Current findings: ", "history": "Historical/background: "}


def _population(age: Column) -> Column:
    return F.when(age.isNull(), "").when(age < 18, "child").when(age >= 65, "older adult").otherwise("adult")


def _input_rules() -> dict[str, Column]:
    n = F.size("facts")
    return {
        "role": F.col("role").isin(*PREFIXES), "facts": (n >= 1) & (n <= 4), "kind": F.forall("facts", lambda f: f["kind"] == F.col("role")),
        "population": F.col("population") == _population(F.col("age")), "text": F.col("text") != "",
    }


def input_faults(queries: DataFrame) -> DataFrame:
    """query_id, rule: queries that no reranker input may be made of."""
    return violations(queries, _input_rules(), ["query_id"])


def reranker_inputs(queries: DataFrame) -> DataFrame:
    """query_id, role, variant, text: each query as it is, with its role's template around its facts, and with its role's prefix alone.

    queries: query_id, role, text, facts (array of structs of kind and text), age, population. Reading it fails at a query with a fault. Age is
    said of history alone, and no fact of one role enters the other's text.
    """
    findings = tx.joined(F.transform("facts", lambda f: f["text"]))
    phrase = F.create_map(*[F.lit(x) for kv in POPULATIONS.items() for x in kv])[F.col("population")]
    current = F.col("role") == "symptoms"
    explicit = F.when(current, F.format_string(CURRENT, findings)).otherwise(F.format_string(BACKGROUND, phrase, findings))
    prefix = F.when(current, PREFIXES["symptoms"]).otherwise(PREFIXES["history"])
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("text")) for v, c in (("original", F.col("text")), ("role_explicit", explicit), ("prefix_only", F.concat(prefix, "text")))])
    return checked(queries, _input_rules()).select("query_id", "role", F.inline(variants))

"""Retrieval quality and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as tx

DEPTHS = (5, 10, 20, 50)


def relevance(candidates: DataFrame, system_ranks: DataFrame, mode: str = "strict", depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """system, n_positive, recall_k for each depth, mrr; all null where nothing was reviewed.

    candidates: candidate_id, label, reviewed. system_ranks: candidate_id, system, rank, depth (captured).
    """
    labels = ["relevant"] if mode == "strict" else ["relevant", "partially_relevant"]
    judged = candidates.select("candidate_id", "reviewed", (F.col("reviewed") & F.col("label").isin(labels)).alias("hit"))
    totals = judged.agg(F.count_if("hit").alias("n_positive"), F.max("reviewed").alias("any_reviewed"))
    told = system_ranks.join(judged, "candidate_id")
    hits = lambda k: F.count_if(F.col("hit") & (F.col("rank") <= F.least(F.lit(k), F.col("depth"))))
    by = told.groupBy("system").agg(*[hits(k).alias(f"h{k}") for k in depths], F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"))
    all_ = by.crossJoin(F.broadcast(totals))  # one row
    live = F.col("any_reviewed") & (F.col("n_positive") > 0)
    return all_.select(
        "system",
        F.when(F.col("any_reviewed"), F.col("n_positive")).alias("n_positive"),
        *[F.when(live, F.round(F.col(f"h{k}") / F.col("n_positive"), 9)).alias(f"recall_{k}") for k in depths],
        F.when(live, F.coalesce(F.round(1.0 / F.col("best"), 9), F.lit(0.0))).alias("mrr"),
    )


def aligned(ranks: DataFrame, item: str, systems: list[str]) -> DataFrame:
    """One row for each item with every system's rank, null where a system does not have it."""
    return ranks.groupBy(item).pivot("system", systems).agg(F.min("rank"))


def paired(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, before, after, delta of two runs."""
    left, right = a.select(*key, F.col(value).alias("before")), b.select(*key, F.col(value).alias("after"))
    return left.join(right, key).withColumn("delta", F.col("after") - F.col("before"))


def drift(pairs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: pairs, largest and mean absolute change, changes of sign, and whether all is within tolerance."""
    flip = (F.col("before") > 0) != (F.col("after") > 0)
    size = F.abs("delta")
    return pairs.agg(F.count("*").alias("pairs"), F.max(size).alias("max_abs"), F.round(F.avg(size), 9).alias("mean_abs"), F.count_if(flip).alias("flips"), (F.coalesce(F.max(size), F.lit(0.0)) <= tolerance).alias("passed"))


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of kept, gained, lost and absent eligibility (a positive score)."""
    was, now = F.col("before") > 0, F.col("after") > 0
    move = F.when(was & now, "kept").when(~was & now, "gained").when(was & ~now, "lost").otherwise("absent")
    return pairs.groupBy(*by, move.alias("direction")).agg(F.count("*").alias("n"))


def ratio(n: Column, d: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(n, d), 9)


def histogram(events: DataFrame, key: str, rule: str) -> DataFrame:
    """reason, n: rules of each key, sorted and joined by ` + `, and how many keys have them."""
    reasons = events.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(rule)), " + ").alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def trace(items: DataFrame, stages: list[tuple[str, DataFrame]], on: str) -> DataFrame:
    """on, lost_at: the first stage that does not have an item; null where all do."""
    out = items.select(on)
    for name, have in stages:
        out = out.join(have.select(on).distinct().withColumn(f"__{name}", F.lit(True)), on, "left")
    missing = F.coalesce(*[F.when(F.col(f"__{name}").isNull(), F.lit(name)) for name, _ in stages])
    return out.select(on, missing.alias("lost_at"))


def compared(baseline: DataFrame, chosen: DataFrame, by: str, item: str) -> DataFrame:
    """by, both, baseline_only, selector_only: two selections of items, counted where they agree and where not."""
    a, b = baseline.select(by, item).distinct().withColumn("__a", F.lit(True)), chosen.select(by, item).distinct().withColumn("__b", F.lit(True))
    x, y = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return a.join(b, [by, item], "full").groupBy(by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("baseline_only"), F.count_if(~x & y).alias("selector_only"))


def merged_counters(df: DataFrame, by: list[str], counter: str) -> DataFrame:
    """by, counter: the sums of a counter, a map of names to numbers or of names to such maps, over the rows of each group.

    Counts are added name by name, so tasks add up their own rows before the shuffle and no group's maps come together but as their sum. Groups
    whose counters are all empty or null have an empty map.
    """
    kind = df.schema[counter].dataType
    nested = kind.valueType.typeName() == "map"
    level = df.select(*by, F.explode_outer(counter).alias("__outer", "__value"))
    level = level.select(*by, "__outer", F.explode_outer("__value").alias("__inner", "__count")) if nested else level.select(*by, F.lit(None).cast("string").alias("__inner"), "__outer", F.col("__value").alias("__count"))
    sums = level.groupBy(*by, "__outer", "__inner").agg(F.sum("__count").alias("__count"))

    def entries(name: str, value: str) -> Column:
        pairs = F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(name), F.col(value))))
        return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)))

    if nested:
        sums = sums.groupBy(*by, "__outer").agg(entries("__inner", "__count").alias("__count"))
    return sums.groupBy(*by).agg(entries("__outer", "__count").alias(counter))


def hypotheses(diagnosis: Column) -> Column:
    """The primary hypothesis, where there is one, and the differential ones after it."""
    return F.concat(F.array_compact(F.array(diagnosis["primary"])), F.coalesce(diagnosis["differential"], F.array().cast("array<void>")))


def cited(diagnosis: Column) -> Column:
    """References of all claims of a diagnosis in order: of each hypothesis its rationale, what supports it and what contradicts it, then treatment."""
    refs = lambda claims: F.flatten(F.transform(claims, lambda c: c["refs"]))
    return F.concat(F.flatten(F.transform(hypotheses(diagnosis), lambda h: F.concat(h["rationale"]["refs"], refs(h["supporting"]), refs(h["contradicting"])))), F.coalesce(refs(diagnosis["treatment"]), F.array().cast("array<string>")))


def case_measures(cases: DataFrame, top_k: int = 5) -> DataFrame:
    """Measures of each case; null is what could not be measured, never a miss.

    cases: case_id, status, truth, diagnosis (struct of primary, differential, treatment, unsupported; null where none was accepted), critique (struct of arrays; null
    where there is none), and the three kinds of ids that a claim may cite: facts, patient_cases, knowledge. Conditions are equal but for case and white space.
    """
    d, norm = F.col("diagnosis"), lambda c: F.lower(tx.clean(c))
    told = cases.withColumn("__h", F.when(d.isNotNull(), hypotheses(d))).withColumn("__refs", F.coalesce(F.when(d.isNotNull(), cited(d)), F.array().cast("array<string>")))
    told = told.withColumn("__p", F.array_distinct(F.transform("__h", lambda h: norm(h["condition"])))).withColumn("__t", F.nullif(norm(F.col("truth")), F.lit("")))
    none = F.array().cast("array<string>")
    allowed = F.concat(*[F.coalesce(c, none) for c in ("facts", "patient_cases", "knowledge")])
    told = told.withColumn("__ok", F.size(F.filter("__refs", lambda r: F.array_contains(allowed, r))))
    n, done = F.size("__refs"), F.col("status") == "success"
    measurable = F.coalesce(F.col("__t").isNotNull() & (F.size("__p") > 0), F.lit(False))
    first = norm(d["primary"]["condition"]) == F.col("__t")
    among = F.array_contains(F.slice("__p", 1, top_k), F.col("__t"))
    scored = F.col("__t").isNotNull() & d.isNotNull()
    flags = ["unsupported_points", "contradictions", "missing_evidence", "hallucination_flags", "safety_flags"]
    count = lambda f: F.size(F.coalesce(F.col("critique")[f], none))
    when_critic = lambda c: F.when(F.col("critique").isNotNull(), c)
    return told.select(
        "case_id", measurable.alias("measurable"), F.when(measurable & d["primary"].isNotNull(), first).alias("accepted_primary_match"), F.when(measurable, among).alias("accepted_top_k_match"),
        F.when(d.isNull(), "no_accepted_diagnosis").when(F.size("__p") == 0, "accepted_abstention").alias("note"), F.when(scored, done & F.coalesce(first, F.lit(False))).alias("primary_match"), F.when(scored, done & F.coalesce(among, F.lit(False))).alias("top_k_match"),
        n.alias("citations"), F.col("__ok").alias("valid_citations"), F.when(n > 0, F.round(F.col("__ok") / n, 9)).alias("coverage"), (n - F.col("__ok")).alias("hallucinated"), F.when(d.isNotNull(), F.size(F.coalesce(d["unsupported"], none))).alias("unsupported"),
        when_critic(count("hallucination_flags")).alias("critic_hallucinations"), when_critic(sum((count(f) for f in flags), F.lit(0))).alias("critic_flags"),
    )


def claims_at(diagnosis: Column) -> Column:
    """Every claim of a diagnosis as (hypothesis, path, refs), in order; hypothesis is null for treatment. Paths are pointers into the diagnosis."""
    text = lambda i: i.cast("string")
    one = lambda root, path, claim: F.struct(root.alias("hypothesis"), path.alias("path"), claim["refs"].alias("refs"))

    kind = "array<struct<hypothesis:string,path:string,refs:array<string>>>"
    none = F.array().cast(kind)

    def listed(claims: Column, root: Column, name: str) -> Column:
        return F.coalesce(F.transform(claims, lambda c, i: one(root, F.concat(root, F.lit(f"/{name}/"), text(i)), c)).cast(kind), none)

    def of(h: Column, root: Column) -> Column:
        rationale = F.array(one(root, F.concat(root, F.lit("/rationale")), h["rationale"])).cast(kind)
        return F.concat(rationale, listed(h["supporting"], root, "supporting_evidence"), listed(h["contradicting"], root, "contradicting_evidence"))

    first = F.when(diagnosis["primary"].isNotNull(), of(diagnosis["primary"], F.lit("/primary_hypothesis")).cast(kind)).otherwise(none)
    rest = F.flatten(F.transform(diagnosis["differential"], lambda h, i: of(h, F.concat(F.lit("/differential_diagnoses/"), text(i))).cast(kind)))
    care = F.transform(diagnosis["treatment"], lambda c, i: one(F.lit(None).cast("string"), F.concat(F.lit("/treatment/actions/"), text(i), F.lit("/proposal")), c)).cast(kind)
    return F.concat(first, F.coalesce(rest, none), F.coalesce(care, none))


def claim_links(cases: DataFrame) -> DataFrame:
    """case_id, path, hypothesis, patient, analogous, medical (the claim's references of each kind, sorted, once each), supported, bare.

    cases: as for case_measures. A claim without a medical reference is not supported; one whose whole hypothesis has none is bare. All in the row of the case.
    """
    told = cases.select("case_id", "facts", "patient_cases", "knowledge", claims_at(F.col("diagnosis")).alias("__claims"))
    none = F.array().cast("array<string>")
    of = lambda refs, ids: F.array_sort(F.array_intersect(refs, F.coalesce(F.col(ids), none)))
    backed = F.array_distinct(F.transform(F.filter("__claims", lambda c: F.size(of(c["refs"], "knowledge")) > 0), lambda c: c["hypothesis"]))
    each = told.withColumn("__backed", backed).select("*", F.explode("__claims").alias("c"))
    bare = F.col("c.hypothesis").isNotNull() & ~F.coalesce(F.array_contains("__backed", F.col("c.hypothesis")), F.lit(False))
    medical = of(F.col("c.refs"), "knowledge")
    return each.select("case_id", "c.path", "c.hypothesis", of(F.col("c.refs"), "facts").alias("patient"), of(F.col("c.refs"), "patient_cases").alias("analogous"), medical.alias("medical"), (F.size(medical) > 0).alias("supported"), bare.alias("bare"))

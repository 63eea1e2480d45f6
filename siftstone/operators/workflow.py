"""Event-sourced workflows: legal transitions, budgets, routing, safety folds, hash-chained logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Stages and where each may lead; the second map is the workflow with treatment and safety stages.
TRANSITIONS = {
    "INITIAL": ["PATIENT"],
    "PATIENT": ["EVIDENCE"],
    "EVIDENCE": ["DIAGNOSTIC", "ABSTENTION"],
    "DIAGNOSTIC": ["GROUNDING"],
    "DIAGNOSTIC_REVISION": ["GROUNDING"],
    "GROUNDING": ["CRITIC", "UNRESOLVED"],
    "CRITIC": ["ROUTE"],
    "ROUTE": ["FINAL", "ABSTENTION", "UNRESOLVED", "BLOCKED", "DIAGNOSTIC_REVISION"],
}
GATED_TRANSITIONS = TRANSITIONS | {
    "DIAGNOSTIC": ["GROUNDING", "TREATMENT"],
    "DIAGNOSTIC_REVISION": ["GROUNDING", "TREATMENT"],
    "TREATMENT": ["GROUNDING"],
    "CRITIC": ["SAFETY_VALIDATION"],
    "SAFETY_VALIDATION": ["ROUTE"],
    "ROUTE": [*TRANSITIONS["ROUTE"], "HUMAN_REVIEW"],
}
FAILURE = "TERMINAL_FAILURE"
TERMINAL = ["FINAL", "ABSTENTION", "UNRESOLVED", "BLOCKED", FAILURE]
GATED_TERMINAL = [*TERMINAL, "HUMAN_REVIEW"]
# Categories of a safety assessment, and those that block.
CATEGORIES = [
    "invented_patient_facts", "unsupported_certainty", "similarity_as_probability", "analogy_as_outcome", "source_misrepresentation",
    "prohibited_action", "unsafe_delay", "diagnostic_critic_contradiction", "instruction_following", "safety_ambiguity",
]
BLOCKING = ["prohibited_action", "unsafe_delay", "instruction_following"]


def edges(spark: SparkSession, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in transitions.items() for b in to], "from_stage string, to_stage string")


def illegal_steps(events: DataFrame, run: str, order: list[Column], stage: str, allowed: DataFrame, terminal: list[str], anywhere: str | None = FAILURE) -> DataFrame:
    """Events whose stage may not follow the one before: no edge, or anything after a terminal stage."""
    w = Window.partitionBy(run).orderBy(*order)
    steps = events.withColumn("from_stage", F.lag(stage).over(w)).withColumn("to_stage", F.col(stage)).filter("from_stage is not null")
    ended = F.col("from_stage").isin(terminal) if terminal else F.lit(False)
    free = F.col("to_stage") == anywhere if anywhere else F.lit(False)
    judged = steps.join(F.broadcast(allowed.withColumn("__ok", F.lit(True))), ["from_stage", "to_stage"], "left")  # a few dozen edges
    return judged.filter(ended | (F.col("__ok").isNull() & ~free)).drop("__ok")


def running(df: DataFrame, by: list[str], order: list[Column], **sums: str) -> DataFrame:
    """Adds running totals: new name = summed column."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(w).alias(k) for k, c in sums.items()])


def first_breach(df: DataFrame, by: list[str], seq: str, over: Column) -> DataFrame:
    """The first seq of each group for which `over` holds; null where none does."""
    return df.groupBy(*by).agg(F.min(F.when(over, F.col(seq))).alias("breach"))


def reserved(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: float, most: int, reserve: float) -> DataFrame:
    """df with calls and spent before each row, and refusal: why the call may not begin, null where it may.

    A call needs `reserve` of the budget before it begins, whatever it will cost: spent + reserve > budget refuses it, as does a number of calls that has reached `most`.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = df.withColumn("calls", F.count("*").over(w)).withColumn("spent", F.round(F.coalesce(F.sum(cost).over(w), F.lit(0.0)), 4))
    return told.withColumn("refusal", F.when(F.col("calls") >= most, "calls").when(F.col("spent") + reserve > budget, "reserve"))


def stale_tickets(tickets: DataFrame, current: DataFrame, run: str, fields: list[str]) -> DataFrame:
    """tickets with stale: the fields in which a ticket is not that of its run's current state (run, fields); `run` where the run has none.

    A ticket holds where nothing is stale: equality of all fields, nulls being equal to nulls.
    """
    now = current.select(run, F.lit(True).alias("__known"), *[F.col(f).alias(f"__{f}") for f in fields])
    met = tickets.join(now, run, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]))
    return met.withColumn("stale", F.when(F.col("__known"), wrong).otherwise(F.array(F.lit("run")))).drop("__known", *[f"__{f}" for f in fields])


def route(flags: Column, assessment: Column, issues: Column, hypotheses: Column, revision: Column, most: int = 2) -> Column:
    """(next_stage, outcome, reason) of a critique; flags, issues and hypotheses are counts."""
    to = lambda stage, outcome, reason: F.struct(F.lit(stage).alias("next_stage"), F.lit(outcome).cast("string").alias("outcome"), F.lit(reason).alias("reason"))
    again = (assessment == "revision_required") | (issues > 0)
    return (
        F.when(flags > 0, to("BLOCKED", "safety_blocked", "critic_safety_flags"))
        .when(assessment == "insufficient_evidence", to("ABSTENTION", "insufficient_evidence", "critic_insufficient_evidence"))
        .when(again & (revision >= most), to("UNRESOLVED", "max_revisions_reached", "max_revisions_reached"))
        .when(again, to("DIAGNOSTIC_REVISION", None, "unresolved_critic"))
        .when(hypotheses == 0, to("ABSTENTION", "diagnostic_agent_abstention", "diagnostic_agent_abstention"))
        .otherwise(to("FINAL", "accepted_with_limitations", "critic_supported_with_limitations"))
    )


def gated_route(decision: Column, flags: Column, base: Column) -> Column:
    """Safety first: a block, then human review, then the base route."""
    to = lambda stage, outcome, reason: F.struct(F.lit(stage).alias("next_stage"), F.lit(outcome).alias("outcome"), reason.alias("reason"))
    return (
        F.when((flags > 0) | (decision == "BLOCK"), to("BLOCKED", "safety_blocked", F.when(flags > 0, "critic_safety_flags").otherwise("safety_block")))
        .when(decision == "HUMAN_REVIEW", to("HUMAN_REVIEW", "human_review_required", F.lit("safety_human_review")))
        .otherwise(base)
    )


def safety_fold(findings: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """run, decision, reasons, n_findings: any BLOCK blocks, any finding asks for review, none continues."""
    told = findings.groupBy(run).agg(F.max(F.col("disposition") == "BLOCK").alias("__b"), F.count("*").alias("n_findings"), F.array_sort(F.collect_set("code")).alias("reasons"))
    decision = F.when(F.col("__b"), "BLOCK").when(F.col("n_findings") > 0, "HUMAN_REVIEW").otherwise("CONTINUE")
    none = F.array().cast("array<string>")
    return runs.select(run).distinct().join(told, run, "left").select(run, decision.alias("decision"), F.coalesce("reasons", none).alias("reasons"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def disposition(category: Column) -> Column:
    return F.when(category.isin(BLOCKING), "BLOCK").otherwise("HUMAN_REVIEW")


def coverage_faults(assessments: DataFrame, run: str, categories: list[str] | None = None) -> DataFrame:
    """run, category, n: categories that a run does not assess exactly once."""
    wanted = assessments.select(run).distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories or CATEGORIES))))
    have = assessments.groupBy(run, "category").agg(F.count("*").alias("n"))
    return wanted.join(have, [run, "category"], "full").select(run, "category", F.coalesce("n", F.lit(0)).alias("n")).filter(
        (F.col("n") != 1) | ~F.col("category").isin(categories or CATEGORIES)
    )


def final_decision(workflow: Column, failed: Column, covered: Column, decision: Column) -> Column:
    """ALLOW only for a finished, fully assessed workflow that may continue; else BLOCK or HUMAN_REVIEW."""
    good = (workflow == "final") & ~failed & covered & (decision == "CONTINUE")
    return F.when(F.coalesce(good, F.lit(False)), "ALLOW").when((workflow == "human_review_required") & ~failed, "HUMAN_REVIEW").otherwise("BLOCK")


def chain(df: DataFrame, by: list[str], order: list[Column], payload: Column) -> DataFrame:
    """Adds sha (of the row's payload) and previous_sha (of the row before)."""
    hashed = df.withColumn("sha", F.sha2(payload, 256))
    return hashed.withColumn("previous_sha", F.lag("sha").over(Window.partitionBy(*by).orderBy(*order)))


def chain_faults(log: DataFrame, by: list[str], seq: str, terminal: Column) -> DataFrame:
    """Rows that break the chain: a gap in seq, another previous hash, or anything after a terminal row."""
    w = Window.partitionBy(*by).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = log.select(
        "*", F.row_number().over(w).alias("__n"), F.lag("sha").over(w).alias("__sha"), F.coalesce(F.max(terminal.cast("int")).over(before), F.lit(0)).alias("__over"), F.min(seq).over(Window.partitionBy(*by)).alias("__first")
    )
    fault = (
        F.when(F.col(seq) - F.col("__first") + 1 != F.col("__n"), "sequence").when(~F.col("previous_sha").eqNullSafe(F.col("__sha")), "hash").when(F.col("__over") == 1, "after_terminal")
    )
    return told.withColumn("fault", fault).filter("fault is not null").drop("__n", "__sha", "__over", "__first")


def repeats(df: DataFrame, by: list[str], order: list[Column], digest: Column) -> DataFrame:
    """Adds seen_before: how often the run had the same fingerprint before this row."""
    w = Window.partitionBy(*by, "__d").orderBy(*order)
    return df.withColumn("__d", digest).withColumn("seen_before", F.row_number().over(w) - 1).drop("__d")


def scalars(record: Column, allowed: dict[str, str]) -> Column:
    """Array of (name, kept) of a JSON record: of the allowed names and types alone, numbers that are finite and not negative, truth values as 1 and 0."""

    def one(name: str, kind: str) -> Column:
        raw = F.from_json(record, f"`{name}` {kind}")[name]
        number = raw.cast("double")
        sound = number if kind == "boolean" else F.when(~F.isnan(number) & (number >= 0) & (number < float("inf")), number)
        return F.struct(F.lit(name).alias("name"), sound.alias("kept"))

    return F.array(*[one(n, k) for n, k in allowed.items()])


def outcomes(events: DataFrame, run: str, order: list[Column], stage: str, legal: DataFrame, terminal: list[str], cost: str, budget: float) -> DataFrame:
    """run, events, outcome, stopped_at: ILLEGAL or BUDGET by what comes first in a run's order of events, else its last stage."""
    w = Window.partitionBy(run).orderBy(*order)
    e = events.withColumn("__n", F.row_number().over(w)).withColumn("__before", F.lag(stage).over(w)).withColumn("__spent", F.round(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), 4))
    ok = legal.select(F.col("from_stage").alias("__before"), F.col("to_stage").alias(stage), F.lit(True).alias("__ok")).distinct()
    e = e.join(F.broadcast(ok), ["__before", stage], "left")  # the stated edges
    illegal = F.col("__before").isNotNull() & (F.col("__before").isin(terminal) | F.col("__ok").isNull())
    by = e.groupBy(run).agg(
        F.count("*").alias("events"), F.min(F.when(illegal, F.col("__n"))).alias("__i"), F.min(F.when(F.col("__spent") > budget, F.col("__n"))).alias("__b"), F.max_by(stage, "__n").alias("__last")
    )
    first = F.col("__i").isNotNull() & (F.col("__b").isNull() | (F.col("__i") <= F.col("__b")))
    return by.select(run, "events", F.when(first, "ILLEGAL").when(F.col("__b").isNotNull(), "BUDGET").otherwise(F.col("__last")).alias("outcome"), F.least("__i", "__b").alias("stopped_at"))

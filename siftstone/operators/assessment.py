"""Safety assessments made again from their input: findings of nested claims, their fold, and stored ones that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.workflow import disposition

_ENTRY = "finding_id string, origin string, code string, disposition string, path string, excerpt string, refs array<string>"
FINDINGS = f"array<struct<{_ENTRY}>>"
ASSESSMENT = f"struct<semantic_status:string,findings:{FINDINGS},decision:string,reasons:array<string>>"
#: Input of a run: flags array<string>; hypotheses array<struct<path, condition, claims array<struct<refs array<string>>>>>, the primary one first;
#: medical array<string>, ids of medical evidence; categories array<struct<category, result, entries array<struct<path, excerpt, refs>>>>, null where the model was not asked.


def _finding(code: Column, origin: str, finding_id: Column, how: Column, path: Column, excerpt: Column, refs: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(finding_id.alias("finding_id"), F.lit(origin).alias("origin"), code.alias("code"), how.alias("disposition"), path.alias("path"), F.substring(excerpt, 1, 2000).alias("excerpt"), (none if refs is None else F.coalesce(refs, none)).alias("refs"))


def findings(flags: Column, hypotheses: Column, medical: Column, categories: Column) -> Column:
    """FINDINGS of a run, without a shuffle: flags, hypotheses that cite no medical evidence, then categories; the model's are not read where there is a flag."""
    none = F.array().cast(FINDINGS)

    def flagged(text: Column, i: Column) -> Column:
        said = F.trim(text) != ""
        where = F.when(said, F.concat(F.lit("/safety_flags/"), i.cast("string")))
        return _finding(F.lit("critic_safety_flags"), "deterministic", F.concat(F.lit("deterministic:critic:"), i.cast("string")), F.lit("BLOCK"), where, F.when(said, text))

    cites = lambda h: F.arrays_overlap(F.flatten(F.transform(h["claims"], lambda c: F.coalesce(c["refs"], F.array().cast("array<string>")))), medical)
    bare = F.transform(
        F.filter(hypotheses, lambda h: ~F.coalesce(cites(h), F.lit(False))),
        lambda h: _finding(F.lit("missing_medical_reference"), "deterministic", F.concat(F.lit("deterministic:medical:"), h["path"]), F.lit("HUMAN_REVIEW"), F.concat(h["path"], F.lit("/condition")), h["condition"]),
    )

    def told(c: Column) -> Column:
        how = F.when((c["result"] == "issue_identified"), disposition(c["category"])).otherwise("HUMAN_REVIEW")
        name = lambda i: F.concat(F.lit("semantic:"), c["category"], F.lit(":"), i.cast("string"))
        empty = F.array(_finding(c["category"], "semantic", name(F.lit(0)), how, F.lit(None).cast("string"), F.lit(None).cast("string")))
        return F.when(F.size(c["entries"]) > 0, F.transform(c["entries"], lambda e, i: _finding(c["category"], "semantic", name(i), how, e["path"], e["excerpt"], e["refs"]))).otherwise(empty)

    semantic = F.flatten(F.transform(F.filter(categories, lambda c: c["result"] != "no_issue_identified"), told))
    return F.concat(
        F.coalesce(F.transform(flags, flagged), none), F.coalesce(bare, none), F.when(F.size(flags) > 0, none).otherwise(F.coalesce(semantic, none))
    ).cast(FINDINGS)


def assess(runs: DataFrame) -> DataFrame:
    """runs with assessment (ASSESSMENT): any blocking finding blocks, any other asks for review; reasons are the distinct codes, sorted."""
    made = runs.withColumn("__f", findings(F.col("flags"), F.col("hypotheses"), F.col("medical"), F.col("categories")))
    decision = F.when(F.exists("__f", lambda f: f["disposition"] == "BLOCK"), "BLOCK").when(F.size("__f") > 0, "HUMAN_REVIEW").otherwise("CONTINUE")
    status = F.when(F.size("flags") > 0, "skipped_critic_block").otherwise("completed")
    reasons = F.array_sort(F.array_distinct(F.transform("__f", lambda f: f["code"])))
    return made.withColumn("assessment", F.struct(status.alias("semantic_status"), F.col("__f").alias("findings"), decision.alias("decision"), reasons.alias("reasons"))).drop("__f")


def forged(runs: DataFrame, stored: DataFrame, run: str) -> DataFrame:
    """run, fields: stored assessments (run, assessment as JSON) that are not what their input makes; `missing` or `unreadable` where there is none.

    Both sides are compared field by field after they went through the same JSON, so neither order of keys nor spaces count, and a field that is not there is none.
    """
    made = assess(runs).select(run, F.to_json("assessment").alias("__made"))
    told = made.join(stored.select(run, F.col("assessment").alias("__text")), run, "left")
    read = lambda c: F.from_json(F.col(c), ASSESSMENT)
    told = told.withColumn("__m", read("__made")).withColumn("__s", read("__text"))
    names = ["semantic_status", "findings", "decision", "reasons"]
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"__m.{n}").eqNullSafe(F.col(f"__s.{n}")), n) for n in names]))
    broken = F.when(F.col("__text").isNull(), F.array(F.lit("missing"))).when(F.col("__s").isNull() | F.forall(F.array(*[F.col(f"__s.{n}").isNull() for n in names]), lambda x: x), F.array(F.lit("unreadable")))
    return told.select(run, F.coalesce(broken, wrong).alias("fields")).filter(F.size("fields") > 0)

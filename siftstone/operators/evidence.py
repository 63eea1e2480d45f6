"""Evidence: snapshots, spans in source texts, references of claims, wording consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of observations, and of wording that is negative, unknown, or too involved to judge.
OBSERVATIONS = {
    "dyspnea": r"\b(?:dyspn(?:ea|oea)|shortness of breath|difficulty breathing|breathlessness|breathing difficulty)\b",
    "choking": r"\b(?:choking|suffocating)\b",
    "palpitations": r"\b(?:palpitations?|heart racing|racing heart)\b",
    "tingling": r"\b(?:tingling|numbness|par(?:a)?esthesia\w*)\b",
    "detachment": r"\b(?:detach(?:ed|ment)|depersonalization|derealization)\b",
    "fear_of_dying": r"\b(?:fear of dying|afraid of dying|feel like you are dying)\b",
    "sweating": r"\b(?:sweating|diaphoresis)\b",
    "chest_pain": r"\b(?:chest pain|chest tightness|side of the chest)\b",
    "fever": r"\b(?:fever|febrile)\b",
    "cough": r"\b(?:cough|coughing)\b",
    "wheezing": r"\b(?:wheez(?:e|ing))\b",
    "onset_score": r"\b(?:onset (?:speed|score)|how fast.*(?:appear|onset))\b",
    "localization_score": r"\b(?:localization precision|localization score|how precis(?:e|ely))\b",
}
INVOLVED = r"\b(?:may|might|could|can|possible|possibly|if|unless|whether|risk|rule out|not confirmed|cannot|without|does not|do not|not established)\b"
NEGATIVE = r"\b(?:no|denies|denied|absent)\b"
UNKNOWN = r"\b(?:unknown|unreported|not reported|not documented|unavailable|missing)\b"
# Wording of ages in titles and sections, with the ages meant.
POPULATIONS = (
    ("older_adult", r"\b(older adults?|elderly|seniors?|geriatric)\b", 65, float("inf")),
    ("infant", r"\b(infants?|babies|newborns?)\b", 0, 1),
    ("child", r"\b(child|children|pediatric|paediatric)\b", 0, 17),
    ("teen", r"\b(teens?|teenagers?|adolescents?)\b", 13, 17),
    ("adult", r"\badults?\b", 18, float("inf")),
)


def ascii_words(pattern: str) -> str:
    """A pattern of whole words, \\b(?:..)\\b, without case, whose words end where ASCII words do on every Java (before 19, \\b goes by Unicode words); a dot is any character but a line feed."""
    if not (pattern.startswith(r"\b") and pattern.endswith(r"\b") and r"\b" not in pattern[2:-2]):
        raise ValueError(f"no pattern of whole words: {pattern}")
    return r"(?id)(?<!\w)" + pattern[2:-2] + r"(?!\w)"


def snapshot(rows: DataFrame, by: list[str], key: str, *fields: str) -> DataFrame:
    """by, n_rows, snapshot_id: SHA-256 over the rows' fields in order of the key; null fields count as \\N."""
    line = F.concat_ws("\t", F.col(key).cast("string"), *[F.coalesce(F.col(f).cast("string"), F.lit("\\N")) for f in fields])
    lines = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), 256).alias("snapshot_id"))


def availability(has_a: Column, has_b: Column, a: str = "A", b: str = "B") -> Column:
    return F.when(has_a & has_b, "BOTH").when(has_a, f"{a}_ONLY").when(has_b, f"{b}_ONLY").otherwise("NONE")


def span_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points, half open."""
    return text.substr(start + 1, end - start)


def span_holds(text: Column, start: Column, end: Column, quoted: Column) -> Column:
    return (end > start) & (start >= 0) & (end <= F.length(text)) & (span_text(text, start, end) == quoted)


def enclosing(points: DataFrame, bounds: DataFrame, key: str, at: str, bound: str) -> DataFrame:
    """Adds section_start: the greatest bound of the same key that is not beyond the point.

    One sorted pass over the union of both sides: an as-of join whose cost is the sum of the sides, not their product.
    """
    left = points.withColumn("__at", F.col(at)).withColumn("__side", F.lit(1))
    right = bounds.select(key, F.col(bound).alias("__at"), F.lit(0).alias("__side"), F.col(bound).alias("__bound"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("section_start", F.last("__bound", ignorenulls=True).over(w))
    return both.filter("__side = 1").drop("__at", "__side", "__bound")


def merge_spans(spans: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """by, start, end: overlapping spans, and those at most gap apart, as one (islands of a sorted pass)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    islands = spans.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def quoted_spans(quotes: DataFrame, sources: DataFrame, key: str, gap: int = 0) -> DataFrame:
    """key, start, end, text, chunk_id: where the reviewed quotes (key, quote) stand first in their sources (key, text), overlapping ones as one.

    Quotes that do not stand there give nothing: missing_quotes() tells them.
    """
    at = F.instr(F.col("text"), F.col("quote"))
    met = quotes.join(sources.select(key, "text"), key).filter(F.col("quote") != "").withColumn("start", at - 1).filter("start >= 0")
    spans = merge_spans(met.select(key, "start", (F.col("start") + F.length("quote")).alias("end")), [key], gap)
    told = spans.join(sources.select(key, "text"), key)
    name = F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2("text", 256), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return told.select(key, "start", "end", span_text(F.col("text"), F.col("start"), F.col("end")).alias("text"), name.alias("chunk_id"))


def missing_quotes(quotes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, quote of quotes that do not stand in their source, or have none."""
    met = quotes.join(sources.select(key, F.col("text").alias("__t")), key, "left")
    return met.filter(F.col("__t").isNull() | (F.instr(F.col("__t"), F.col("quote")) < 1)).select(key, "quote")


def claim_refs(claims: DataFrame, key: str, path: str, refs: str) -> DataFrame:
    return claims.select(key, path, F.explode(refs).alias("ref"))


def unseen_urls(text: Column, supplied: Column) -> Column:
    """Addresses in a text that the supplied text does not have."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", ""))
    return F.filter(F.array_distinct(found), lambda u: ~supplied.contains(u))


def supported(quote: Column, rendered: Column, literals: Column) -> Column:
    """A quote is a rendered fact or stands within an answer."""
    return F.array_contains(rendered, quote) | F.exists(literals, lambda x: x.contains(quote))


def population_status(age: Column, title: Column) -> Column:
    """match, mismatch or unknown: the ages that a title names against an age."""
    low = F.lower(title)
    plain = F.regexp_replace(low, r"\bolder adults?\b", "")
    named = F.array_compact(F.array(*[F.when((low if k == "older_adult" else plain).rlike(p), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))) for k, p, lo, hi in POPULATIONS]))
    fits = F.exists(named, lambda r: (age >= r["lo"]) & (age <= r["hi"]))
    return F.when(age.isNull() | (F.size(named) == 0), "unknown").when(fits, "match").otherwise("mismatch")


def observations(text: Column) -> Column:
    """Names of the observations that a clause mentions."""
    return F.array_compact(F.array(*[F.when(text.rlike(ascii_words(p)), F.lit(k)) for k, p in OBSERVATIONS.items()]))


def polarity(text: Column) -> Column:
    return F.when(text.rlike(ascii_words(INVOLVED)), "involved").when(text.rlike(ascii_words(UNKNOWN)), "unknown").when(text.rlike(ascii_words(NEGATIVE)), "negative").otherwise("positive")


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?i)[.;!?\n]+|\bbut\b|\bhowever\b"), lambda x: F.trim(x)), lambda x: x != "")


def consistency(claims: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, clause, concept, status: each observation of a claim's clauses against the facts that the claim cites.

    claims: key, text, refs (array); facts: ref, concept, polarity. Claims without refs, clauses without an observation and
    involved wording are unassessed; else a cited fact must have the concept in the same polarity.
    """
    said = claims.select(key, "refs", F.posexplode(clauses(F.col("text"))).alias("clause_no", "clause"))
    said = said.withColumn("polarity", polarity(F.col("clause"))).withColumn("concept", F.explode_outer(observations(F.col("clause"))))
    cited = claims.select(key, F.explode("refs").alias("ref")).join(facts, "ref").select(F.col(key).alias("__k"), F.col("concept").alias("__c"), F.when(F.col("polarity") == "recorded", "positive").otherwise(F.col("polarity")).alias("__p")).distinct()
    met = said.join(cited, (F.col(key) == F.col("__k")) & (F.col("concept") == F.col("__c")) & (F.col("polarity") == F.col("__p")), "left").drop("__k")
    skip = (F.size("refs") == 0) | F.col("concept").isNull() | (F.col("polarity") == "involved")
    status = F.when(skip, "unassessed").when(F.col("__c").isNull(), "mismatch").otherwise("no_mismatch_in_checked_observations")
    return met.select(key, "clause_no", "clause", "concept", "polarity", status.alias("status"))


# Answers that deny and that tell nothing, and the concepts for which a bare number says something.
DENIED, UNTOLD, SCALES = ("no", "none", "nowhere"), ("unknown", "", "not reported"), ("onset_score", "localization_score")


def fact_concepts(fact: Column) -> Column:
    """(concepts, polarity) of a fact: a question's answer decides, a bare number records scale concepts alone; a fact without an answer by its wording."""
    asked = fact.contains(" = ")
    answer = F.lower(F.trim(F.get(F.split(fact, " = ", 2), 1)))
    names = observations(fact)
    number = asked & answer.rlike(r"^[+-]?\d+(?:\.\d+)?$")
    plain = F.when(fact.rlike(ascii_words(UNKNOWN)), "unknown").when(fact.rlike(ascii_words(NEGATIVE)), "negative").otherwise("positive")
    told = F.when(answer.isin(*DENIED), "negative").when(answer.isin(*UNTOLD), "unknown").when(number, "recorded").otherwise("positive")
    kept = F.when(number, F.filter(names, lambda x: x.isin(*SCALES))).otherwise(names)
    return F.struct(F.coalesce(kept, F.array().cast("array<string>")).alias("concepts"), F.when(fact.isNull(), "unknown").when(asked, told).otherwise(plain).alias("polarity"))


def claim_clauses(text: Column) -> Column:
    """Clauses of a claim: parted by stops, by but and whereas, and by and where a denial follows."""
    return F.filter(F.split(text, r"(?i)[.;\n]|\b(?:but|whereas)\b|\band\s+(?=no\b|denies\b)"), lambda x: F.trim(x) != "")


def reference_checks(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """case_id, claim_no, clause_no, concept, result, reason: each observation of a claim's clauses against the facts that this very claim cites.

    claims: case_id, claim_no, text, refs (array). facts: case_id, ref, text (null where a fact is no text). A claim that cites no fact of its case, and a clause
    without an observation or of involved wording, is unassessed (concept null): no match is never a pass. Scales that are recorded count as positive.
    """
    told = facts.select("case_id", "ref", fact_concepts(F.col("text")).alias("f"))
    refs = claims.select("case_id", "claim_no", F.explode("refs").alias("ref")).distinct().join(told, ["case_id", "ref"])
    cites = refs.select("case_id", "claim_no").distinct().withColumn("cites", F.lit(True))
    said = refs.select("case_id", "claim_no", F.explode("f.concepts").alias("concept"), F.when(F.col("f.polarity") == "recorded", "positive").otherwise(F.col("f.polarity")).alias("polarity"))
    said = said.groupBy("case_id", "claim_no", "concept").agg(F.collect_set("polarity").alias("polarities"))
    clauses_ = claims.join(cites, ["case_id", "claim_no"], "left").select("case_id", "claim_no", "cites", F.posexplode(F.when(F.col("cites"), claim_clauses(F.col("text"))).otherwise(F.array(F.col("text")))).alias("clause_no", "clause"))
    open_ = F.col("cites") & ~F.col("clause").rlike(ascii_words(INVOLVED))
    clause = F.col("clause")
    polarity_ = F.when(clause.rlike(ascii_words(UNKNOWN)), "unknown").when(clause.rlike(ascii_words(NEGATIVE)), "negative").otherwise("positive")
    names = clauses_.select("case_id", "claim_no", "clause_no", polarity_.alias("polarity"), F.explode_outer(F.when(open_, observations(clause))).alias("concept"))
    met = names.join(said, ["case_id", "claim_no", "concept"], "left")
    fits = F.array_contains("polarities", F.col("polarity"))
    result = F.when(F.col("concept").isNull(), "unassessed").when(fits, "consistent").otherwise("mismatch")
    reason = F.when(F.col("concept").isNull(), None).when(fits, "concept_and_polarity_match").when(F.col("polarities").isNotNull(), "patient_reference_polarity_mismatch").otherwise("patient_reference_concept_mismatch")
    return met.select("case_id", "claim_no", "clause_no", "concept", result.alias("result"), reason.alias("reason"))

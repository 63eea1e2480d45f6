"""From the facts of a case to its queries: inventories of observed concepts, grouped queries, and joins of concepts with texts by set containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions import text as tx
from siftstone.operators import models
from siftstone.operators.selection import semantic_groups

# The fields of a case in their order, and the wording of concepts in queries.
FIELDS = ("presenting_evidence", "symptoms", "antecedents")
WORDING = {
    "detachment": "feeling detached from body or surroundings",
    "numbness tingling": "numbness and tingling",
    "hypochondrium": "upper abdominal pain",
    "flank": "flank pain",
    "breast": "breast pain",
    "cramp": "cramping pain",
}
NUMBER = r"^[-+]?\d+(\.\d+)?$"
NEGATED, EMPTY = "negative_unknown_or_uninterpreted_numeric", "no_informative_positive_concept"


def population(age: Column) -> Column:
    return F.when(age.isNull(), "").when(age < 18, "child").when(age >= 65, "older adult").otherwise("adult")


def _read(facts: DataFrame) -> DataFrame:
    """case_id, kind, fact_id, place (field, pos), text, reason, concepts."""
    field = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")).cast("int")
    concepts = F.when(tx.positive(F.col("text"), NUMBER), tx.concepts(F.col("text"))).otherwise(F.array().cast("array<string>"))
    told = facts.select(
        "case_id", F.when(F.col("field") == "antecedents", "history").otherwise("symptoms").alias("kind"), F.concat_ws(":", F.lit("patient"), "field", F.col("pos").cast("string")).alias("fact_id"),
        F.struct(field.alias("field"), "pos").alias("place"), "text", tx.positive(F.col("text"), NUMBER).alias("stated"), concepts.alias("concepts"),
    )
    return told.withColumn("reason", F.when(~F.col("stated"), NEGATED).when(F.size("concepts") == 0, EMPTY)).drop("stated")


def ignored_facts(facts: DataFrame) -> DataFrame:
    """case_id, fact_id, text, reason of the facts (case_id, field, pos, text) that no query is made of."""
    return _read(facts).filter("reason is not null").select("case_id", "fact_id", "text", "reason")


def observed(facts: DataFrame) -> DataFrame:
    """case_id, kind, pos, concept, text, fact_ids: a row for each concept of a kind, in order of first sight, with all facts that name it."""
    named = _read(facts).filter("reason is null").select("case_id", "kind", "fact_id", "place", F.posexplode("concepts").alias("nth", "concept"))
    seen = F.struct("place", "nth", "fact_id")
    by = named.groupBy("case_id", "kind", "concept").agg(F.min(seen).alias("first"), F.array_sort(F.collect_list(seen)).alias("all"))
    ids = F.array_distinct(F.transform("all", lambda x: x["fact_id"]))
    wording = F.col("concept")
    for concept, said in WORDING.items():
        wording = F.when(F.col("concept") == concept, said).otherwise(wording)
    order = Window.partitionBy("case_id", "kind").orderBy("first")
    return by.select("case_id", "kind", (F.row_number().over(order) - 1).alias("pos"), "concept", wording.alias("text"), ids.alias("fact_ids"))


def query_plan(facts: DataFrame, cases: DataFrame, model: models.Embedder) -> DataFrame:
    """case_id, query_id, kind, text, concepts, fact_ids: queries of groups of like concepts, symptoms first.

    cases: case_id, age. Symptoms fall into about a quarter as many groups as there are, at most four; history into at most six. A history query
    names the population; concepts keep their order of first sight within a group, and groups that of their first concepts.
    """
    told = observed(facts)
    texts = told.select("text").distinct()
    vectors = models.embed(texts, model, "text", "text").select("text", F.col("embedding").cast("array<double>").alias("vector"))
    groups = semantic_groups(told.join(vectors, "text").select("case_id", "kind", "pos", "vector"))
    member = F.struct("pos", "text", "concept", "fact_ids")
    by = told.join(groups, ["case_id", "kind", "pos"]).groupBy("case_id", "kind", "group").agg(F.array_sort(F.collect_list(member)).alias("m"))
    said = F.array_join(F.transform("m", lambda x: x["text"]), "; ")
    told = by.join(cases.select("case_id", population(F.col("age")).alias("population")), "case_id", "left")
    history = F.concat_ws(" ", F.nullif("population", F.lit("")), said, F.lit("symptoms and clinical information"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("kind"), F.element_at("m", 1)["pos"])) - 1
    return told.select(
        "case_id", F.concat_ws(":", "kind", number.cast("string")).alias("query_id"), "kind", F.when(F.col("kind") == "history", history).otherwise(said).alias("text"),
        F.transform("m", lambda x: x["concept"]).alias("concepts"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["fact_ids"]))).alias("fact_ids"),
    )


def focused_query(facts: DataFrame, cases: DataFrame, most_symptoms: int = 12, most_history: int = 4) -> DataFrame:
    """case_id, symptom_concepts, history_concepts, query: one query of a case (case_id, age, sex) from its first concepts of each kind.

    A bare decimal is read as such here only without sign and point; a concept of the symptoms is none of the history.
    """
    field = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")).cast("int")
    named = facts.select("case_id", (F.col("field") == "antecedents").alias("history"), F.struct(field.alias("field"), "pos").alias("place"), F.posexplode(tx.concepts(F.col("text"))).alias("nth", "concept"))
    first = named.groupBy("case_id", "concept").agg(F.min(F.when(~F.col("history"), F.struct("place", "nth"))).alias("s"), F.min(F.when(F.col("history"), F.struct("place", "nth"))).alias("h"))
    listed = lambda at, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(F.col(at).alias("at"), "concept")))), lambda x: x["concept"])
    by = first.groupBy("case_id").agg(listed("s", F.col("s").isNotNull()).alias("s"), listed("h", F.col("h").isNotNull()).alias("h"))
    # a concept is taken from the history where it is none of the symptoms that are kept
    by = by.withColumn("s", F.slice("s", 1, most_symptoms)).withColumn("h", F.slice(F.array_except("h", "s"), 1, most_history))
    none = F.array().cast("array<string>")
    told = cases.join(by, "case_id", "left").withColumn("s", F.coalesce("s", none)).withColumn("h", F.coalesce("h", none))
    age = F.when(F.col("age") < 18, "pediatric").when(F.col("age") >= 65, "older adult").when(F.col("age").isNotNull(), "adult")
    sex = F.when(F.col("sex") == "F", "female").when(F.col("sex") == "M", "male")
    some = lambda c: F.nullif(F.array_join(c, "; "), F.lit(""))
    text = F.concat_ws(" ", age, sex, some("s"), F.concat(F.lit("history: "), some("h")), F.lit("clinical information red flags"))
    return told.select("case_id", F.col("s").alias("symptom_concepts"), F.col("h").alias("history_concepts"), text.alias("query"))


def concept_matches(texts: DataFrame, key: str, concepts: DataFrame) -> DataFrame:
    """key, concept: texts (key, text) whose words hold all words of one of a concept's alternatives (concept, alternative).

    A set-containment join: an alternative meets texts by its rarest word alone, and its other words are then counted among the text's by
    (text, word). So rows of single words cross the shuffles, never a text's array, and a frequent word is no join key of an alternative that has a rarer one.
    Words are runs of a to z of the lower-cased text; an alternative without words is in no text.
    """
    words = texts.select(key, F.explode(tx.word_set(F.col("text"))).alias("word"))
    asked = concepts.select("concept", F.array_sort(tx.word_set(F.col("alternative"))).alias("words")).distinct()
    needed = asked.filter(F.size("words") > 0).select("concept", "words", F.explode("words").alias("word"))
    words = words.join(needed.select("word").distinct(), "word", "left_semi")
    spread = words.groupBy("word").agg(F.count("*").alias("df"))
    words = words.hint("merge")  # never broadcast: files of equal texts are far smaller than their words
    rare = needed.join(spread, "word").groupBy("concept", "words").agg(F.min(F.struct("df", "word")).alias("least"), F.count("*").alias("found")).filter(F.col("found") == F.size("words"))
    met = words.join(rare.select("concept", "words", F.col("least.word").alias("word")), "word").select(key, "concept", "words")
    done = met.filter(F.size("words") == 1).select(key, "concept")
    others = met.filter(F.size("words") > 1).select(key, "concept", F.xxhash64("words").alias("__a"), F.size("words").alias("__n"), F.explode("words").alias("word"))
    whole = others.join(words, [key, "word"]).groupBy(key, "concept", "__a", "__n").agg(F.count("*").alias("__have")).filter("__have = __n").select(key, "concept")
    return done.union(whole).distinct()


def concept_gate(candidates: DataFrame, plans: DataFrame, titles: DataFrame, bodies: DataFrame, key: str, annotate: bool = False) -> DataFrame:
    """candidates (query_id, key, ..) with retained, reason, title_matches, symptom_matches.

    plans: query_id, kind, concept. titles and bodies: concept_matches(). A candidate stays with a concept of its plan in the title, or with two of its symptoms in
    the body; with annotate every one stays and nothing but the matches is told.
    """
    held = lambda of, kinds, name: (
        candidates.select("query_id", key).distinct().join(plans.filter(F.col("kind").isin(kinds)), "query_id").join(of, [key, "concept"]).groupBy("query_id", key).agg(F.array_sort(F.collect_set("concept")).alias(name))
    )
    none = F.array().cast("array<string>")
    told = candidates.join(held(titles, ["symptoms", "history"], "title_matches"), ["query_id", key], "left").join(held(bodies, ["symptoms"], "symptom_matches"), ["query_id", key], "left")
    told = told.withColumn("title_matches", F.coalesce("title_matches", none)).withColumn("symptom_matches", F.coalesce("symptom_matches", none))
    if annotate:
        return told.withColumn("retained", F.lit(True)).withColumn("reason", F.lit("candidate_for_reranking"))
    title, body = F.size("title_matches") > 0, F.size("symptom_matches") >= 2
    reason = F.when(title, "topic_title_overlap").when(body, "multiple_symptom_overlap").otherwise("insufficient_concept_overlap")
    return told.withColumn("retained", title | body).withColumn("reason", reason)

"""Literal catalog lookup and alias resolution.

Entries: entry_id, topic, kind, file, url, phrases (array of arrays of words), terms (array of informative words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions import text as tx

MOST_QUERY_CHARS = 4096


def lookup(entries: DataFrame, queries: DataFrame, stop: list[str], k: int | None = 5) -> DataFrame:
    """query_id, entry_id, match, overlap, coverage, rank for queries (query_id, query, words).

    An entry is a candidate if it shares an informative word. It matches exactly (3) if the query is one of its phrases, by
    phrase (2) if one stands in the query, partly (1) by two shared words that are half of its own, or by one that is a
    phrase in itself or in at most two entries. A query of more than 4096 characters fails.

    Entries of the same topic, phrases and terms meet queries as one, and so do queries of the same words: copies on either side add no
    pairs. Of such entries only the first k in catalog order can be among the first k of a query.
    """
    whole = queries.filter(F.when(F.length("query") <= MOST_QUERY_CHARS, F.lit(True)).otherwise(F.raise_error(F.lit("query too long")).cast("boolean")))
    asked = whole.groupBy("words").agg(F.min("query_id").alias("__query")).withColumn("__q", tx.informative(F.col("words"), stop))
    same = Window.partitionBy("__topic", "phrases", "terms").orderBy("kind", "file", "url", "entry_id")
    kept = entries.withColumn("__topic", F.lower("topic")).withColumn("__nth", F.row_number().over(same)).withColumn("__class", F.first("entry_id").over(same))
    kept = kept if k is None else kept.filter(F.col("__nth") <= k)
    classes = kept.filter("__nth = 1").select("__class", "__topic", "phrases", F.array_distinct("terms").alias("terms"))
    df = entries.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    alone = classes.select(F.explode(F.filter("phrases", lambda p: F.size(p) == 1)).alias("p"), "terms").filter(F.array_contains("terms", F.col("p")[0])).select(F.col("p")[0].alias("term")).distinct().withColumn("alone", F.lit(True))
    strong = F.coalesce(F.col("alone"), F.lit(False)) | (F.col("df") <= 2)
    posts = classes.select("__class", F.explode("terms").alias("term"))
    met = posts.join(asked.select("__query", F.explode("__q").alias("term")), "term").join(df.join(alone, "term", "left").select("term", strong.alias("strong")), "term").groupBy("__query", "__class").agg(F.count("*").alias("overlap"), F.max("strong").alias("strong"))
    told = met.join(classes, "__class").join(asked.select("__query", "words"), "__query").withColumn("coverage", F.round(F.col("overlap") / F.size("terms"), 9))
    exact = F.exists("phrases", lambda p: p == F.col("words"))
    phrase = F.exists("phrases", lambda p: tx.contains_phrase(F.col("words"), p))
    partly = ((F.col("overlap") >= 2) & (F.col("coverage") >= 0.5)) | ((F.col("overlap") == 1) & F.col("strong"))
    strength = F.when(exact, 3).when(phrase, 2).when(partly, 1)
    found = told.withColumn("strength", strength).filter("strength is not null").select("__query", "__class", "__topic", "strength", "overlap", "coverage")
    order = [F.desc("strength"), F.desc("overlap"), F.desc("coverage"), F.asc("__topic")]
    if k is not None:  # each class before another in this order gives at least one entry before its own
        found = found.withColumn("__before", F.rank().over(Window.partitionBy("__query").orderBy(*order))).filter(F.col("__before") <= k)
    each = found.join(kept.select("__class", "entry_id", "kind", "file", "url"), "__class")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("__query").orderBy(*order, "kind", "file", "url", "entry_id")))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    names = F.element_at(F.array(F.lit("partial"), F.lit("topic_phrase"), F.lit("exact")), F.col("strength"))
    out = ranked.select("__query", "entry_id", names.alias("match"), "overlap", "coverage", "rank")
    return whole.join(asked.select("words", "__query"), "words").join(out, "__query").select("query_id", "entry_id", "match", "overlap", "coverage", "rank")


def alias_matches(queries: DataFrame, aliases: DataFrame, guarded: list[str]) -> DataFrame:
    """query_id, alias, topic_id, start for queries (query_id, words: as written) and aliases (alias, topic_id).

    Aliases are matched word by word without case. Where one lies within a longer match it gives way. A guarded alias is an
    acronym that is also a common word: it counts only where the query has it in capitals.
    """
    words = queries.select("query_id", F.posexplode("words").alias("start", "word"))
    parts = aliases.select("alias", "topic_id", F.split(F.lower("alias"), " ").alias("parts"))
    met = words.join(parts, F.lower("word") == F.col("parts")[0]).join(queries, "query_id")
    here = F.slice("words", F.col("start") + 1, F.size("parts"))
    met = met.filter(F.transform(here, lambda x: F.lower(x)) == F.col("parts")).withColumn("end", F.col("start") + F.size("parts"))
    met = met.withColumn("raw", F.array_join(here, " "))
    spans = F.collect_set(F.struct("start", "end")).over(Window.partitionBy("query_id"))  # as many as a query has matches
    longer = F.exists("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")) & (s["end"] - s["start"] > F.col("end") - F.col("start")))
    plain = F.lower("alias").isin(guarded) & (F.col("raw") != F.upper("raw")) if guarded else F.lit(False)
    return met.withColumn("spans", spans).filter(~longer & ~plain).select("query_id", "alias", "topic_id", "start")


def alias_diagnostics(matches: DataFrame, watched: list[str]) -> DataFrame:
    """query_id, alias, applied, watched of matches (query_id, query, expanded, alias, title): whether the title that an alias proposes is among
    those that the expanded query added behind the untouched query, and whether the alias is an ordinary word to watch."""
    lead = F.concat("query", F.lit("\nSource topic: "))
    added = F.when(F.col("expanded").startswith(lead), F.split(F.col("expanded").substr(F.length(lead) + 1, F.length("expanded")), "; ")).otherwise(F.array().cast("array<string>"))
    return matches.select("query_id", "alias", F.array_contains(added, F.col("title")).alias("applied"), F.col("alias").isin(watched).alias("watched"))


def sentence_windows(text: Column, budget: int) -> Column:
    """Sentences folded into windows of at most `budget` words; a longer sentence fails."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s) != "")
    size = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.when(size(s) <= budget, s).otherwise(F.raise_error(F.lit("a sentence over the budget")).cast("string"))
        fits = (F.size(acc) > 0) & (size(last) + size(s) <= budget)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), own)))).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)

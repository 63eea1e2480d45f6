"""Sections around quotes: headings and paragraphs of plain texts, two-sided as-of joins, budgets that fail and never cut.

A text has HEADER lines before its body. A heading is a line that is not empty over a line of two or more `=` (first level) or `-` (second
level). Where a body has first-level headings these alone bound its sections; else all headings do; where it has none, blank lines bound paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.operators.evidence import merge_spans, span_text

HEADER = 4


def lines(docs: DataFrame, key: str) -> DataFrame:
    """key, no, at, size, filled, rule: a row for each line, where it begins and whether it underlines a heading. Texts stay behind."""
    told = docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    told = told.select(key, "no", F.length("line").alias("size"), F.regexp_extract("line", r"^(=|-)\1+\r?$", 1).alias("rule"))
    before = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("at", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))).withColumn("filled", F.col("size") > 0)


def boundaries(docs: DataFrame, key: str, header: int = HEADER) -> DataFrame:
    """key, at, opens, closes: where sections of a body may begin and where they may end.

    A line that underlines a heading is no heading of the line below it: of lines in a row that could be headings, every second one is.
    """
    w = Window.partitionBy(key).orderBy("no")
    told = lines(docs, key).filter(F.col("no") >= header)
    told = told.withColumn("under", F.lead("rule").over(w)).withColumn("next_at", F.lead("at").over(w))
    told = told.withColumn("could", F.col("filled") & (F.coalesce("under", F.lit("")) != ""))
    row = F.col("no") - F.coalesce(F.max(F.when(~F.col("could"), F.col("no"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(header - 1))
    told = told.withColumn("level", F.when(F.col("could") & (row % 2 == 1), F.col("under")))
    whole = Window.partitionBy(key)
    told = told.withColumn("top", F.max(F.col("level") == "=").over(whole)).withColumn("any", F.max(F.col("level").isNotNull()).over(whole))
    told = told.withColumn("body", F.min("at").over(whole)).withColumn("end", F.max(F.col("at") + F.col("size")).over(whole))
    heading = F.col("level").isNotNull() & (~F.coalesce("top", F.lit(False)) | (F.col("level") == "="))
    blank = ~F.col("any") & ~F.col("filled") & F.col("next_at").isNotNull() & (F.col("no") > header)
    edge = lambda at, opens, closes: F.struct(at.cast("long").alias("at"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
    both = F.filter(
        F.array(
            F.when(F.col("no") == header, edge(F.col("body"), True, True)), F.when(F.col("no") == header, edge(F.col("end"), True, True)),
            F.when(heading, edge(F.col("at"), True, True)), F.when(blank, edge(F.col("next_at"), True, False)), F.when(blank, edge(F.col("at") - 1, False, True)),
        ),
        lambda x: x.isNotNull(),
    )
    return told.select(key, F.inline(both))


def anchors(docs: DataFrame, quotes: DataFrame, key: str, header: int = HEADER) -> DataFrame:
    """key, quote, start, end, fault: where a quote stands in its body; missing, ambiguous, or no_body where it cannot be told."""
    parts = F.split("text", "\n", header + 1)
    body = F.when(F.size(parts) == header + 1, F.get(parts, header))
    met = quotes.join(docs.select(key, F.length("text").alias("__n"), body.alias("__b")), key, "left")
    times = F.when(F.length("quote") > 0, (F.length("__b") - F.length(F.replace("__b", "quote", F.lit("")))) / F.length("quote")).otherwise(0)
    start = (F.col("__n") - F.length("__b") + F.instr(F.col("__b"), F.col("quote")) - 1).cast("long")
    fault = F.when(F.col("__b").isNull(), "no_body").when(times == 0, "missing").when(times > 1, "ambiguous")
    return met.select(key, "quote", F.when(fault.isNull(), start).alias("start"), F.when(fault.isNull(), start + F.length("quote")).alias("end"), fault.alias("fault"))


def between(points: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """points (key, start, end, ..) with section_start, the greatest bound that opens at or before start, and section_end, the least that closes at or after end.

    A two-sided as-of join in one sorted pass over both sides: cost is their sum. Equal points are one.
    """
    named = [c for c in points.columns if c != key]
    held = F.struct(*[F.col(c) for c in named]).alias("__p")
    sides = points.distinct().select(key, held, F.inline(F.array(F.struct(F.col("end").cast("long").alias("at"), F.lit(-1).alias("__k")), F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("__k")))))
    both = sides.unionByName(bounds.select(key, "at", F.lit(0).alias("__k"), "opens", "closes"), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("at", "__k")
    opened = F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.first(F.when(F.col("closes"), F.col("at")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    told = both.withColumn("__o", opened).withColumn("__c", closed).filter("__k <> 0")
    by = told.groupBy(key, "__p").agg(F.max(F.when(F.col("__k") == 1, F.col("__o"))).alias("section_start"), F.max(F.when(F.col("__k") == -1, F.col("__c"))).alias("section_end"))
    return by.select(key, "__p.*", "section_start", "section_end")


def section_spans(docs: DataFrame, quotes: DataFrame, key: str, budget: int = 12_000, header: int = HEADER) -> tuple[DataFrame, DataFrame]:
    """Spans (key, start, end, text, chunk_id) of whole sections around the quotes (key, quote) of docs (key, text), and faults (key, quote, fault).

    A document with a quote that is missing or ambiguous, or whose sections together have more than `budget` characters
    (over_budget, quote null), gives faults and no span. Sections that touch or overlap are one; none is ever cut.
    """
    told = anchors(docs, quotes, key, header)
    wrong = told.filter("fault is not null").select(key, "quote", "fault").distinct()
    sound = told.filter("fault is null").join(wrong.select(key).distinct(), key, "left_anti").select(key, "start", "end")
    wanted = docs.join(sound.select(key).distinct(), key, "left_semi")
    found = between(sound, boundaries(wanted, key, header), key).select(key, F.col("section_start").alias("start"), F.col("section_end").alias("end"))
    merged = merge_spans(found, [key])
    size = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(key))
    sized = merged.withColumn("__size", size)
    over = sized.filter(F.col("__size") > budget).select(key, F.lit(None).cast("string").alias("quote"), F.lit("over_budget").alias("fault")).distinct()
    kept = sized.filter(F.col("__size") <= budget).join(docs.select(key, "text"), key)
    name = F.concat(F.sha2("text", 256), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return kept.select(key, "start", "end", span_text(F.col("text"), F.col("start"), F.col("end")).alias("text"), name.alias("chunk_id")), wrong.unionByName(over)

"""Coded case rows to facts: decoding by dimension, value meanings, conflicts, initial evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Spellings of yes and no, and of abbreviated answers.
YES, NO = ["1", "true", "yes"], ["0", "false", "no"]
ANSWERS = {"N": "No", "Y": "Yes", "NA": "Not applicable"}


def listed(text: Column) -> Column:
    """A quoted list such as ['a', 'b'] as an array."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def code_and_raw(token: Column) -> tuple[Column, Column]:
    parts = F.split(token, "_@_", 2)
    return F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))


def decode(cases: DataFrame, dim: DataFrame, values: DataFrame) -> DataFrame:
    """case_id, pos, code, raw, question, answer, is_antecedent, fault for cases (case_id, evidences: array of tokens).

    dim: code, question, data_type (B, C or M), is_antecedent. values: code, raw, meaning. The first of equal (code, raw)
    pairs stays. fault: unknown_code, bad_binary, unknown_value, conflict (two values of a code that has one), or null.
    """
    code, raw = code_and_raw(F.col("token"))
    tokens = cases.select("case_id", F.posexplode("evidences").alias("pos", "token")).select("case_id", "pos", code.alias("code"), raw.alias("raw"))
    tokens = tokens.withColumn("__n", F.row_number().over(Window.partitionBy("case_id", "code", "raw").orderBy("pos"))).filter("__n = 1").drop("__n")
    told = tokens.join(dim, "code", "left").join(values, ["code", "raw"], "left")
    low = F.lower("raw")
    binary = F.when(F.col("raw").isNull() | low.isin(YES), "Yes").when(low.isin(NO), "No")
    short = F.coalesce(*[F.when(F.col("meaning") == k, F.lit(v)) for k, v in ANSWERS.items()], F.col("meaning"))
    number = F.when(F.col("raw").rlike(r"^[-+]?\d+(\.\d+)?$"), F.col("raw"))
    answer = F.when(F.col("data_type") == "B", binary).otherwise(F.coalesce(short, number))
    many = F.size(F.collect_set(F.coalesce("raw", F.lit(""))).over(Window.partitionBy("case_id", "code"))) > 1
    fault = (
        F.when(F.col("question").isNull(), "unknown_code").when((F.col("data_type") == "B") & binary.isNull(), "bad_binary").when(answer.isNull(), "unknown_value").when(many & (F.col("data_type") != "M"), "conflict")
    )
    return told.select("case_id", "pos", "code", "raw", "question", answer.alias("answer"), "is_antecedent", fault.alias("fault"))


def fact_text(question: Column, answer: Column) -> Column:
    return F.concat(question, F.coalesce(F.concat(F.lit(" = "), answer), F.lit(" (answer not supplied)")))


def initial(decoded: DataFrame, first: DataFrame) -> DataFrame:
    """The facts that a case's initial token (case_id, token) names: the recorded one of its value, or all of its code."""
    code, raw = code_and_raw(F.col("token"))
    asked = first.select("case_id", code.alias("code"), raw.alias("__raw"))
    return decoded.join(asked, ["case_id", "code"]).filter(F.col("__raw").isNull() | (F.col("raw") == F.col("__raw"))).drop("__raw")


def resolve(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Adds name: names (code, name) looked up by code first, then by name."""
    by_code = names.select(F.col("code").alias(column), F.col("name").alias("__1"))
    by_name = names.select(F.col("name").alias(column), F.col("name").alias("__2")).distinct()
    return df.join(by_code, column, "left").join(by_name, column, "left").withColumn("name", F.coalesce("__1", "__2")).drop("__1", "__2")


def render(facts: DataFrame) -> DataFrame:
    """case_id, text: a line for each question in order of its first fact, its answers joined by ` | `."""
    by = facts.groupBy("case_id", "question").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]), " | ").alias("answers"))
    line = F.struct("pos", F.concat(F.lit("- "), F.col("question"), F.lit(" = "), F.col("answers")).alias("line"))
    return by.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))

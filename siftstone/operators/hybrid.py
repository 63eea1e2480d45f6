"""Hybrid retrieval for cases of several queries: a dense and a lexical channel of each query, fused, freed of equal spans, with a query for each role.

Pools are bounded by depth: at most two rankings of `depth` rows for each query of a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import ranking as rk


def channels(queries: DataFrame, records: DataFrame, key: str, depth: int) -> DataFrame:
    """case_id, query_id, channel, key, rank of queries (case_id, query_id, text, vector) over records (key, text, vector).

    Vectors of records have length 1 or are null; those without one are found by their words alone.
    """
    case = queries.select("case_id", "query_id")
    dense = rk.knn(records, queries.select("query_id", F.col("vector").alias("query")), depth, key=key, vector="vector", partial=True)
    lexical = rk.bm25(records, queries.select("query_id", F.col("text").alias("query")), key, "text", depth=depth)
    found = dense.select("query_id", F.lit("dense").alias("channel"), key, "rank").unionByName(lexical.select("query_id", F.lit("bm25").alias("channel"), key, "rank"))
    return found.join(case, "query_id")


def pool(rankings: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (case_id, key, rrf, origins, fusion_rank) and what was left out (case_id, key, reason): later ones of an equal span.

    Spans are equal but for case and white space; fusion ranks are those before spans are left out.
    """
    lists = rankings.withColumn("channel", F.concat_ws(":", F.col("query_id").cast("string"), "channel"))
    fused = rk.rrf(lists, ["case_id"], key)
    spans = records.join(fused.select(key).distinct(), key, "left_semi").select(key, F.xxhash64(F.lower(tx.clean(F.col("text")))).alias("__span"), F.md5(F.lower(tx.clean(F.col("text"))).cast("binary")).alias("__digest"))
    told = rk.top(fused.join(spans, key), ["case_id", "__span", "__digest"], [F.asc("fusion_rank")], None, "__nth")
    left = told.filter("__nth > 1").select("case_id", key, F.lit("duplicate_source_span").alias("reason"))
    return told.filter("__nth = 1").drop("__nth", "__span", "__digest"), left


def assigned(candidates: DataFrame, rankings: DataFrame, queries: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """case_id, key, kind, query_id, strength, assigned_by: the query of each kind that a candidate is to be judged by.

    That is the one with most strength, the sum of 1 / (60 + rank) over its channels, ties to the greatest id. Where none of the kind found the
    candidate, it is the one nearest to it (dense), ties to the least id: no candidate is left without a query of a kind that the case has.
    """
    strength = rankings.groupBy("case_id", "query_id", key).agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 12).alias("strength"))
    met = candidates.select("case_id", key).join(queries.select("case_id", "query_id", "kind"), "case_id").join(strength, ["case_id", "query_id", key], "left")
    best = met.groupBy("case_id", key, "kind").agg(F.max(F.struct(F.coalesce("strength", F.lit(0.0)).alias("strength"), "query_id")).alias("best"))
    strong = best.filter("best.strength > 0").select("case_id", key, "kind", "best.query_id", "best.strength", F.lit("strength").alias("assigned_by"))
    weak = best.filter("best.strength = 0").select("case_id", key, "kind")
    asked = records.join(weak.select(key).distinct(), key, "left_semi").select(key, F.col("vector").alias("__r"))  # no vectors are made of other records
    weak = weak.join(queries.select("case_id", "query_id", "kind", F.col("vector").alias("__q")), ["case_id", "kind"]).join(asked, key)
    near = weak.withColumn("__dot", F.round(F.coalesce(vec.dot(F.col("__q"), F.col("__r")), F.lit(-2.0)), rk.PLACES))
    nearest = rk.first_of(near, ["case_id", key, "kind"], [F.desc("__dot"), F.asc("query_id")])
    return strong.unionByName(nearest.select("case_id", key, "kind", "query_id", F.lit(0.0).alias("strength"), F.lit("dense").alias("assigned_by")))

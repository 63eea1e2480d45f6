"""Constraints as data: rules give rows of violations; assert_valid() fails the whole step on the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A constraint does not hold."""


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """key, rule: a row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def assert_valid(found: DataFrame, what: str = "input") -> None:
    """Fails closed: raises with the first violations where there is any."""
    if rows := found.take(3):
        raise Violation(f"{what}: {[r.asDict() for r in rows]}")


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df itself; reading it fails at the first row that breaks a rule."""
    good = reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules.values()])
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])), ", ")
    return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("constraint broken: "), names)).cast("boolean")))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(refs: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """References to nothing that is allowed."""
    return refs.join(allowed.select(*on).distinct(), on, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """What is only on one side, with the side; empty where the sets are equal."""
    left, right = a.select(*on).distinct(), b.select(*on).distinct()
    return left.join(right, on, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, on, "left_anti").withColumn("side", F.lit("right")))


def reconcile(stored: DataFrame, rebuilt: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: missing, unexpected, changed or same, from a full outer join on the key."""
    a, b = stored.select(key, F.col(digest).alias("__a")), rebuilt.select(key, F.col(digest).alias("__b"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"))

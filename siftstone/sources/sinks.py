"""Sinks: checked before they are seen, never overwritten by accident, byte-stable where that is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.operators.constraints import Violation, assert_valid, repeated
from siftstone.session import exists, remove


def write_new(df: DataFrame, path: str) -> None:
    """Parquet at a place where nothing is; the committer makes it appear whole."""
    df.write.mode("errorifexists").parquet(path)


def write_apart(features: DataFrame, labels: DataFrame, path: str, label_columns: list[str]) -> None:
    """Features and labels as two tables; a label column among the features is an error."""
    if leaked := sorted(set(features.columns) & set(label_columns)):
        raise ValueError(f"label columns among features: {leaked}")
    spark, halves = features.sparkSession, (f"{path}/features", f"{path}/labels")
    if there := [p for p in halves if exists(spark, p)]:
        raise ValueError(f"already there: {there}")
    try:
        write_new(features, halves[0])
        write_new(labels, halves[1])
    except Exception:
        for p in halves:  # half a pair is none; neither was there before
            remove(spark, p)
        raise


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with sorted keys, in range-sorted files whose concatenation is in order: the same bytes for the same rows."""
    line = ids.canonical_json(**{c: F.col(c) for c in df.columns})
    df.select(*order, line.alias("value")).orderBy(*order).select("value").write.mode("errorifexists").text(path)


def append_record(df: DataFrame, path: str, session: str, payload: Column) -> None:
    """Appends audit rows with their hash, partitioned by session."""
    df.withColumn("sha", F.sha2(payload, 256)).write.mode("append").partitionBy(session).parquet(path)


def create_records(df: DataFrame, path: str, batch: str, record: list[str], payload: Column) -> DataFrame:
    """Audit rows with their hash (sha) as a batch of their own under path, read back; what was recorded before is never written again.

    A batch of that name, a record that the batch has twice, and one that an earlier batch has, are errors before anything is written. The committer makes the
    batch appear whole: a writer that dies leaves none that is read. Two writers of one name at the same moment are the store's to tell apart.
    """
    spark, at = df.sparkSession, f"{path}/batch={batch}"
    if exists(spark, at):
        raise Violation(f"batch {batch} is recorded")
    assert_valid(repeated(df, record), f"batch {batch} repeats records")
    if exists(spark, path):
        before = spark.read.parquet(path).select(*record)
        assert_valid(df.select(*record).join(before, record, "left_semi"), f"batch {batch} has recorded ones")
    write_new(df.withColumn("sha", F.sha2(payload, 256)), at)
    return spark.read.parquet(at)


def publish(df: DataFrame, path: str, version: str, faults: Callable[[DataFrame], DataFrame]) -> str:
    """Stages a version, audits what was written, and points `current` to it only if there is no fault."""
    spark = df.sparkSession
    staged = f"{path}/versions/{version}"
    df.write.mode("errorifexists").parquet(staged)
    assert_valid(faults(spark.read.parquet(staged)), f"version {version}")
    spark.createDataFrame([(version, staged)], "version string, path string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return staged


def current(spark, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.json(f"{path}/current").first()["path"])


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a bounded result; more rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"

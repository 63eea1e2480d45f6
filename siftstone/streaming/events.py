"""Streams of events: windows, deduplication, and the workflow's state machine with its budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of event files, `files` at a time."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def distinct(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; state is forgotten with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


STEPS = "user_id long, event_id long, from_stage string, to_stage string, requests long, spent double, fault string"
STATE = "stage string, requests long, spent double, ended boolean"


def state_machine(events: DataFrame, allowed: dict[str, list[str]], terminal: list[str], most_requests: int, most_spent: float) -> DataFrame:
    """STEPS: every event with its run's totals and fault (illegal, after_terminal, budget) or null.

    Within a micro-batch a run's events are taken in order of (ts, event_id); a batch that comes later is later. State
    is a few numbers for each run.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stage, requests, spent, ended = state.get if state.exists else (None, 0, 0.0, False)
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            requests, spent = requests + 1, spent + (0.0 if pd.isna(e.value) else float(e.value))
            if ended:
                fault = "after_terminal"
            elif stage is not None and e.event_type not in allowed.get(stage, []) and e.event_type not in terminal:
                fault = "illegal"
            elif requests > most_requests or spent > most_spent:
                fault = "budget"
            else:
                fault = None
            out.append((key[0], e.event_id, stage, e.event_type, requests, spent, fault))
            stage, ended = e.event_type, ended or e.event_type in terminal
        state.update((stage, requests, spent, ended))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "from_stage", "to_stage", "requests", "spent", "fault"])

    return events.groupBy("user_id").applyInPandasWithState(step, STEPS, STATE, "append", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows from memory: for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

"""Review sessions as a stream: each session's state machine with its hash chain, its clock and its end, kept in value and map state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

# Events of a session, and those after which it goes on.
EVENTS = ("OFFERED", "REVIEW", "INVALID_INPUT", "DECLINE", "APPROVE", "REJECT", "REQUEST_MORE_EVIDENCE", "NO_RESPONSE", "NON_INTERACTIVE", "INVALIDATED", "INTERRUPTED")
OPEN = ("OFFERED", "REVIEW", "INVALID_INPUT")
DECISIONS = ("APPROVE", "REJECT", "REQUEST_MORE_EVIDENCE")

#: session, seq, event, eligible (whether the case may be approved), sha (of this record), previous_sha.
RECORD = "session long, seq long, event string, eligible boolean, sha string, previous_sha string"
VERDICT = "session long, seq long, event string, fault string, state string"


def fault_of(last: tuple | None, reviewed: bool, identity: bool | None, seq: int, event: str, eligible: bool, previous_sha: str | None) -> str | None:
    """What is wrong with a record after (seq, event, sha) of the one before it; None where the session may go this way."""
    rules = (
        ("unknown_event", event not in EVENTS),
        ("sequence", seq != (last[0] + 1 if last else 1)),
        ("after_end", bool(last) and last[1] not in OPEN),
        ("hash", previous_sha != (last[2] if last else None)),
        ("start", (event == "OFFERED") != (last is None)),
        ("identity", identity is not None and eligible != identity),
        ("second_review", event == "REVIEW" and reviewed),
        ("decision_without_review", event in DECISIONS and not reviewed),
        ("decline_after_review", event == "DECLINE" and reviewed),
        ("not_eligible", event == "APPROVE" and not eligible),
    )
    return next((name for name, broken in rules if broken), None)


class Sessions(StatefulProcessor):
    """State of a session: its last record and standing, counts of its events, and a timer that ends it where nobody answers."""

    def __init__(self, patience_ms: int | None, most_invalid: int):
        self.patience_ms, self.most_invalid = patience_ms, most_invalid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "seq long, event string, sha string, reviewed boolean, eligible boolean, broken boolean")
        self.counts = handle.getMapState("counts", "event string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, reviewed, identity, broken = None, False, None, False
        if self.standing.exists():
            seq, event, sha, reviewed, identity, broken = self.standing.get()
            last = (seq, event, sha)
        heap = sorted((r for frame in rows for r in frame[["seq", "event", "eligible", "sha", "previous_sha"]].itertuples(index=False)), key=lambda r: r.seq)
        for r in heap:
            previous = None if pd.isna(r.previous_sha) else r.previous_sha
            fault = fault_of(last, reviewed, identity, int(r.seq), r.event, bool(r.eligible), previous)
            n = (self.counts.getValue((r.event,))[0] if self.counts.containsKey((r.event,)) else 0) + 1
            self.counts.updateValue((r.event,), (n,))
            if fault is None and r.event == "INVALID_INPUT" and n > self.most_invalid:
                fault = "too_many_invalid"
            reviewed, broken = reviewed or r.event == "REVIEW", broken or fault is not None
            identity = bool(r.eligible) if identity is None else identity
            last = (int(r.seq), r.event, r.sha)
            yield pd.DataFrame([(key[0], last[0], r.event, fault, standing(r.event, broken))], columns=["session", "seq", "event", "fault", "state"])
        self.standing.update((*last, reviewed, identity, broken))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            if last[1] in OPEN:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nobody answered: the session ends without an approval."""
        if self.standing.exists():
            seq, event, sha, reviewed, identity, _ = self.standing.get()
            self.standing.update((seq, "NO_RESPONSE", sha, reviewed, identity, True))
            yield pd.DataFrame([(key[0], seq + 1, "NO_RESPONSE", "timed_out", "pending")], columns=["session", "seq", "event", "fault", "state"])

    def close(self) -> None:
        pass


def standing(event: str, broken: bool) -> str:
    """What a session says so far: a broken one never says approved."""
    return "invalid" if broken else {"APPROVE": "approved", "REJECT": "rejected"}.get(event, "pending")


def review_stream(records: DataFrame, patience_ms: int | None = None, most_invalid: int = 10) -> DataFrame:
    """VERDICT for each record of a stream (RECORD): what is wrong with it and where its session stands.

    A micro-batch brings a session's records in any order and later ones follow in later batches. Needs the RocksDB state store.
    """
    mode = "None" if patience_ms is None else "ProcessingTime"
    return records.groupBy("session").transformWithStateInPandas(Sessions(patience_ms, most_invalid), VERDICT, "Append", mode)


def review_faults(records: DataFrame, most_invalid: int = 10) -> DataFrame:
    """The same VERDICT for a table of whole sessions, by windows: batch and stream give the same rows."""
    w = Window.partitionBy("session").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda e: F.col("event") == e
    r = records.select(
        "*", F.lag("seq").over(w).alias("__seq"), F.lag("event").over(w).alias("__event"), F.lag("sha").over(w).alias("__sha"), F.coalesce(F.max(is_("REVIEW")).over(before), F.lit(False)).alias("__reviewed"),
        F.first("eligible").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__eligible"), F.count_if(is_("INVALID_INPUT")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__invalid"),
    )
    first, decides = F.col("__seq").isNull(), F.col("event").isin(*DECISIONS)
    fault = (
        F.when(~F.col("event").isin(*EVENTS), "unknown_event").when(F.col("seq") != F.coalesce(F.col("__seq") + 1, F.lit(1)), "sequence").when(~first & ~F.col("__event").isin(*OPEN), "after_end")
        .when(~F.col("previous_sha").eqNullSafe(F.col("__sha")), "hash").when(is_("OFFERED") != first, "start").when(F.col("eligible") != F.col("__eligible"), "identity").when(is_("REVIEW") & F.col("__reviewed"), "second_review")
        .when(decides & ~F.col("__reviewed"), "decision_without_review").when(is_("DECLINE") & F.col("__reviewed"), "decline_after_review").when(is_("APPROVE") & ~F.col("eligible"), "not_eligible")
        .when(is_("INVALID_INPUT") & (F.col("__invalid") > most_invalid), "too_many_invalid")
    )
    broken = F.max(F.col("fault").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(broken, "invalid").when(is_("APPROVE"), "approved").when(is_("REJECT"), "rejected").otherwise("pending")
    return r.withColumn("fault", fault).select("session", "seq", "event", "fault", state.alias("state"))

"""Budget packing that skips what does not fit and goes on, as a fold over an ordered array."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pack(items: Column, budget: int, separator: int = 1) -> Column:
    """The items that a greedy walk keeps within budget characters, separators counted."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        cost = acc["used"] + F.length(x) + F.when(acc["used"] > 0, separator).otherwise(0)
        return F.when(cost <= budget, F.struct(cost.cast("int").alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def round_robin(df: DataFrame, by: list[str], role: str, order: Column, role_order: Column) -> DataFrame:
    """Adds turn: the first of every role, then the second of every role, and so on."""
    nth = F.row_number().over(Window.partitionBy(*by, role).orderBy(order))
    return df.withColumn("__n", nth).withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("__n", role_order))).drop("__n")


PRESERVED = "case_id {id}, query string, baseline string, outcome string, tokens int, included array<string>, added array<string>, omitted array<string>"


def merged_answers(facts: list[tuple[str, str, str | None]]) -> str:
    """One entry for each question in order of its first fact (text, short question, answer): its answers joined by bars; facts without an answer stand as they are."""
    entries: dict[tuple, list] = {}
    for text, short, answer in facts:
        entries.setdefault((text.partition(" = ")[0], answer is None), []).append((text, short, answer))
    return "; ".join(e[0][0] if e[0][2] is None else f"{e[0][1]} = {' | '.join(a for _, _, a in e)}" for e in entries.values())


def preserving(facts: DataFrame, tokens: Callable[[str], int], most_tokens: int = 256, most_chars: int = 4000) -> DataFrame:
    """PRESERVED for facts (case_id, pos, text, short, history): the baseline query of each case, and what merging its answers leaves room for.

    The baseline is a plain walk: a fact joins where all taken so far and it fit both budgets, and what does not fit is passed over. Its facts are mandatory. Their merged form is
    tried next: where that does not fit, the baseline stays as it was (outcome baseline_retained); else facts that the baseline lacks join in order, history first, while
    the merged form fits (extended, or compressed where none does). A case's facts are few; they meet in one task, cases do not.
    """
    fits = lambda text: len(text) <= most_chars and tokens(text) <= most_tokens

    def walk(taken: list[int], waiting: list[int], text: Callable[[list[int]], str]) -> list[int]:
        for i in waiting:
            if fits(text([*taken, i])):
                taken = [*taken, i]
        return taken

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos").drop_duplicates("text")
        rows = [(t, s, a if pd.notna(a) else None) for t, s, a in zip(frame["text"], frame["short"], frame["answer"], strict=True)]
        history = frame["history"].tolist()
        plain, merged = (lambda at: "; ".join(rows[i][0] for i in at)), (lambda at: merged_answers([rows[i] for i in at]))
        mandatory = walk([], list(range(len(rows))), plain)
        baseline, taken, outcome = plain(mandatory), mandatory, "baseline_retained"
        query = baseline
        if fits(merged(mandatory)):
            taken = walk(mandatory, sorted(set(range(len(rows))) - set(mandatory), key=lambda i: (not history[i], i)), merged)
            query, outcome = merged(taken), "extended" if len(taken) > len(mandatory) else "compressed"
        texts = lambda at: [rows[i][0] for i in at]
        left = [i for i in range(len(rows)) if i not in taken]
        return pd.DataFrame([(key[0], query, baseline, outcome, tokens(query), texts(taken), texts(taken[len(mandatory):]), texts(left))], columns=[c.split()[0] for c in PRESERVED.split(", ")])

    answer = F.get(F.split("text", " = ", 2), 1).alias("answer")
    return facts.select("case_id", "pos", "text", "short", "history", answer).groupBy("case_id").applyInPandas(one, PRESERVED.format(id=facts.schema["case_id"].dataType.simpleString()))


_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_NEXT = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def units(text: str) -> list[str]:
    """Sentences and list items in order: a line break parts them always, a sentence's end where a capital or a figure follows."""
    return [u for line in _BREAK.split(text) for s in _NEXT.split(line) if (u := s.strip())]


def unit_windows(docs: DataFrame, key: str, text: str, header: str, tokens: Callable[[str], int], most: int = 480) -> DataFrame:
    """key, window, text, tokens: whole units packed in order, as many to a window as the budget holds together with the header.

    No unit is cut. Where one is over the budget by itself its document has no windows but a row for each such unit, with window null: the
    caller looks at these before anything is indexed. tokens counts the header, a line break and the window as one text, so any counter will
    do. Null and blank texts give no row. A document is walked in the task that reads it; nothing is shuffled.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, window int, text string, tokens int"
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(head: str, body: str) -> Iterator[tuple[int | None, str, int]]:
        cost = lambda some: tokens(head + "\n" + "\n".join(some))
        found = units(body)
        if over := [(None, u, n) for u in found if (n := cost([u])) > most]:
            yield from over
            return
        pending, n, at = [], 0, 0
        for u in found:
            if pending and (m := cost([*pending, u])) <= most:
                pending, n = [*pending, u], m
                continue
            if pending:
                yield at, "\n".join(pending), n
                at += 1
            pending, n = [u], cost([u])
        if pending:
            yield at, "\n".join(pending), n

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, head, body in frame.itertuples(index=False, name=None):
                rows += [(k, *w) for w in walk(head or "", body or "")]
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=names).astype({"window": "Int32", "tokens": "int32"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"window": "Int32", "tokens": "int32"})

    return docs.select(key, F.col(header).alias("__header"), F.col(text).alias("__text")).mapInPandas(work, schema)

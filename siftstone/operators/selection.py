"""Sequential choices, one group at a time in Arrow batches: what windows cannot say.

Pools are bounded by the depth of the rankings they come from (about a thousand rows a query), never by the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siftstone.functions import text as tx

POOL = (
    "query_id string, chunk_id string, parent_id string, document_id string, section string, rrf double, symptoms_score double, history_score double, "
    "symptoms_ranking double, history_ranking double, history_query string, mismatch boolean, tokens array<string>"
)
EVENTS = "query_id string, chunk_id string, role string, step int, ranking double, event string"


@dataclass(frozen=True)
class Variant:
    """How a variant differs from the base: what it adds to ranking values, its passes (role, room; None: the final limit), and novelty."""

    doubled: tuple[str, ...] = ()
    mismatch_cost: float = 0.0
    passes: tuple[tuple[str, int | None], ...] = (("history", 1), ("symptoms", None), ("history", None))
    novelty: bool = False


VARIANT_RULES = {
    "base": Variant(),
    "symptoms_weight_2": Variant(doubled=("symptoms",)),
    "background_cap_1": Variant(passes=(("history", 1), ("symptoms", None))),
    "population_penalty": Variant(mismatch_cost=0.5),
    "history_novelty": Variant(novelty=True),
}
VARIANTS = tuple(VARIANT_RULES)


def positive(rows: DataFrame, score: str) -> DataFrame:
    """The rows whose score is positive and finite."""
    return rows.filter((F.col(score) > 0) & (F.col(score) < float("inf")) & ~F.isnan(score))


def _overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / max(1, len(a | b))


def ranked(pool: pd.DataFrame, variant: Variant) -> pd.DataFrame:
    """A row for each candidate and role in which it has a score, in the order in which a pass walks them.

    The variant moves the ranking value alone: what may be taken hangs on the score.
    """
    words = pool["tokens"].map(frozenset)
    folded = pool["section"].fillna("").map(lambda x: x.casefold().strip())
    mismatch = pool["mismatch"].eq(True).astype(float)
    parts = []
    for role in ("symptoms", "history"):
        score = pool[f"{role}_score"]
        value = pool[f"{role}_ranking"] + score * (role in variant.doubled) - variant.mismatch_cost * mismatch
        part = pool[["chunk_id", "parent_id", "document_id", "rrf", "history_query"]].assign(role=role, score=score, ranking=value, words=words, place=list(zip(pool["document_id"], folded, strict=True)))
        parts.append(part[score.notna()])
    return pd.concat(parts).sort_values(["ranking", "rrf", "chunk_id"], ascending=[False, False, True], kind="stable")


@dataclass
class Choice:
    """What is taken so far of one query's pool, and the bounds it is held to."""

    per_document: float
    near: float
    novelty: bool
    room: float = 0
    taken: int = 0
    parents: set = field(default_factory=set)
    documents: Counter = field(default_factory=Counter)
    words: list = field(default_factory=list)
    places: set = field(default_factory=set)
    served: dict = field(default_factory=lambda: defaultdict(set))

    def stale(self, row) -> bool:
        """Its history query was served, and not by another section of this document."""
        by = self.served.get(row.history_query)
        return bool(by) and not (row.document_id in by and row.place not in self.places)

    def take(self, row) -> None:
        self.taken += 1
        self.parents.add(row.parent_id)
        self.documents[row.document_id] += 1
        self.words.append(row.words)
        self.places.add(row.place)
        if row.role == "history":
            self.served[row.history_query].add(row.document_id)


#: Why a row is not taken: the first of these that holds.
REFUSALS: tuple[tuple[str, Callable[[Choice, tuple], bool]], ...] = (
    ("limit", lambda c, row: c.taken >= c.room),
    ("nonpositive", lambda c, row: not row.score > 0),
    ("section_taken", lambda c, row: row.parent_id in c.parents),
    ("document_full", lambda c, row: c.documents[row.document_id] >= c.per_document),
    ("near_duplicate", lambda c, row: any(_overlap(row.words, w) >= c.near for w in c.words)),
    ("redundant_history", lambda c, row: c.novelty and row.role == "history" and c.stale(row)),
)


def choose(pool: pd.DataFrame, limit: int, variant: str = "base", per_document: float = 2, near: float = 0.8, unbounded: bool = False) -> list[tuple]:
    """The event log (chunk_id, role, ranking, event) of one query's selection.

    Each pass of the variant walks its role's rows in order and takes those that no refusal holds for. A pass with a room of its own
    runs only where the limit leaves room for others. unbounded lifts the limit of the other passes: the counterfactual without a final budget.
    """
    rule = VARIANT_RULES[variant]
    order = ranked(pool, rule)
    choice, log = Choice(per_document, near, rule.novelty), []
    for role, own in rule.passes:
        if own is not None and limit <= own:
            continue
        choice.room = own if own is not None else float("inf") if unbounded else limit
        for row in order[order["role"] == role].itertuples():
            event = next((name for name, holds in REFUSALS if holds(choice, row)), "selected")
            if event == "selected":
                choice.take(row)
            log.append((row.chunk_id, role, row.ranking, event))
    return log


def select_variants(pool: DataFrame, limit: int = 5, variants: tuple[tuple[str, bool], ...] = tuple((v, False) for v in VARIANTS)) -> DataFrame:
    """variant, unbounded and EVENTS for each query of pool (POOL) under each (variant, unbounded): the pool is brought together once."""
    if not {v for v, _ in variants} <= set(VARIANTS) or not 0 <= limit <= 5:
        raise ValueError("an unknown variant, or a limit beyond 0 to 5")
    names = [c.split()[0] for c in POOL.split(", ")]
    if lacking := sorted(set(names) - set(pool.columns)):
        raise ValueError(f"columns that the selection reads are not there: {lacking}")

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(v, u, key[0], c, r, i, x, e) for v, u in variants for i, (c, r, x, e) in enumerate(choose(frame, limit, v, unbounded=u))]
        return pd.DataFrame(rows, columns=["variant", "unbounded", "query_id", "chunk_id", "role", "step", "ranking", "event"])

    return pool.select(*names).groupBy("query_id").applyInPandas(one, "variant string, unbounded boolean, " + EVENTS)


def select_evidence(pool: DataFrame, limit: int = 5, variant: str = "base", unbounded: bool = False) -> DataFrame:
    """EVENTS for each query of pool (POOL): every decision with its reason, `selected` ones included.

    variant: one of VARIANTS; unbounded: the counterfactual without the final limit in the last two passes.
    """
    return select_variants(pool, limit, ((variant, unbounded),)).drop("variant", "unbounded")


def selection_changes(events: DataFrame, base: str = "base") -> DataFrame:
    """variant, query_id, chunk_id, change: what each variant of select_variants() gains and loses against the base."""
    taken = events.filter("event = 'selected' and not unbounded")
    names = taken.select("variant").distinct().agg(F.collect_set("variant").alias("__all"))
    by = taken.groupBy("query_id", "chunk_id").agg(F.collect_set("variant").alias("__in")).crossJoin(F.broadcast(names))  # one row
    had = F.array_contains("__in", base)
    other = F.explode(F.when(had, F.array_except("__all", "__in")).otherwise(F.col("__in"))).alias("variant")
    return by.select(other, "query_id", "chunk_id", F.when(had, "lost").otherwise("gained").alias("change"))


def average_link(vectors: list[list[float]], target: int, largest: int = 4) -> list[list[int]]:
    """Groups of row numbers: the two groups of the highest mean cosine merge, while one of at most `largest` can be made, until target."""
    import numpy as np

    m = np.array(vectors, dtype=float)
    sizes = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    if not np.isfinite(m).all() or (sizes == 0).any():
        raise ValueError("a vector that is zero or not finite")
    # sums of the cosines between groups; those of a merged group are the sums of its parts'
    total, groups = (m / sizes) @ (m / sizes).T if len(m) else m, [[i] for i in range(len(m))]
    while len(groups) > target:
        n = np.array([len(g) for g in groups])
        mean = np.where((n[:, None] + n <= largest) & np.triu(np.ones((len(n), len(n)), dtype=bool), 1), total / (n[:, None] * n), -np.inf)
        if (most := mean.max(initial=-np.inf)) == -np.inf:
            break
        i, j = divmod(int(np.argmax(mean.ravel() >= most - 1e-12)), len(n))  # the first of equal ones
        total[i] += total[j]
        total[:, i] += total[:, j]
        total = np.delete(np.delete(total, j, axis=0), j, axis=1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def semantic_groups(facts: DataFrame) -> DataFrame:
    """case_id, kind, group, pos for facts (case_id, kind, pos, vector): symptoms in about n / 4 groups, at most 4; history in at most 6."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n = len(frame)
        target = min(4, -(-n // 4)) if key[1] == "symptoms" else min(6, n)
        groups = average_link(frame["vector"].tolist(), target)
        return pd.DataFrame([(*key, g, int(frame["pos"].iloc[i])) for g, members in enumerate(groups) for i in sorted(members)], columns=["case_id", "kind", "group", "pos"])

    return facts.groupBy("case_id", "kind").applyInPandas(one, f"case_id {facts.schema['case_id'].dataType.simpleString()}, kind string, group int, pos int")


def diverse(features: DataFrame, k: int) -> list[int]:
    """Row numbers of a max-min Jaccard choice from features (row_no, items); the least row is the anchor, ties go to the lower row.

    Each of the k steps is one pass over the features that gives the row farthest from what is chosen: only chosen rows come to the driver.
    """
    chosen: list[Row] = []
    while len(chosen) < k:
        items = lambda c: F.array(*map(F.lit, c["items"])) if c["items"] else F.array().cast("array<string>")
        apart = [1 - tx.jaccard(F.array_distinct("items"), F.array_distinct(items(c))) for c in chosen]
        nearest = F.least(*apart) if len(apart) > 1 else apart[0] if apart else F.lit(0.0)
        left = features.filter(~F.col("row_no").isin([c["row_no"] for c in chosen])) if chosen else features
        best = left.agg(F.max_by(F.struct("row_no", "items"), F.struct(nearest.alias("d"), (-F.col("row_no")).alias("r"))).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
    return [c["row_no"] for c in chosen]

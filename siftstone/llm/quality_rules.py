"""Quality rules: learned decision lists over text statistics, in DataFrame expressions only.

Statistics of every whole text come from built-in functions. A decision list is learned by sequential covering from
the statistics of labelled documents (SAMPLE of them at most, chosen by a hash of the id): a rule grows by the threshold condition of
the best information gain on two thirds of what is left, is pruned from its end on the other third, and is taken if it
covers at least MIN_COVER documents there with PRECISION or more; what it covers leaves the pool. The list becomes
one ordered CASE expression, and each rule can be read as text.

Defined results: null and empty texts have no words and fail the base; without labels of both kinds the list is empty and the base
decides alone; repeated rows get the same result; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, PRECISION, MIN_COVER, MAX_RULES, MAX_TERMS, CUTS = 20_000, 0.97, 8, 12, 4, 48
_BLANK = r"[\x20\x09-\x0D]"
_LOW = (1 << 26) - 1


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper_runs, n_stops, n_lines (long).

    Windows of three words are compared by 64-bit hashes. A window's position rides in the low bits of its
    hash, so one sort of plain longs brings equal windows together; neighbours then compare whole hashes, two on either side, as
    another window of the same high bits may stand between.
    """
    others = [c for c in docs.columns if c != text]
    d = docs.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    d = d.withColumn("__b", F.btrim("__t", F.lit(" \t\n\x0b\x0c\r")))
    d = d.withColumn("__w", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", _BLANK + "+")))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, n = F.col("__w"), F.size("__w")
    d = d.select(
        *others,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__t", F.lit(r"\p{Lu}+")).cast("long").alias("n_upper_runs"),
        F.regexp_count("__t", F.lit(r"[.!?]")).cast("long").alias("n_stops"),
        F.size("__l").cast("long").alias("n_lines"),
        F.when(n >= 3, F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    h = F.col("__h")
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    d = d.withColumn("__p", F.when(F.size(F.array_distinct(h)) < F.size(h), packed).otherwise(F.array().cast("array<bigint>")))
    p = F.col("__p")
    at = lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")

    def twin(x: Column, y: Column) -> Column:
        return F.coalesce((F.shiftright(x, 26) == F.shiftright(y, 26)) & (F.get(h, at(x)) == F.get(h, at(y))), F.lit(False))

    twice = F.filter(p, lambda x, i: twin(x, F.get(p, i - 1)) | twin(x, F.get(p, i + 1)) | twin(x, F.get(p, i - 2)) | twin(x, F.get(p, i + 2)))
    d = d.withColumn("__r", F.sort_array(F.transform(twice, at)))
    r = F.col("__r")
    covered = F.aggregate(F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper_runs", "n_stops", "n_lines")
    # an expression that is not deterministic keeps later filters from being moved below, into the array functions
    fixed = F.when(F.monotonically_increasing_id() >= 0, covered.cast("long")).alias("n_repeat_words")
    return d.select(*others, *names, fixed)


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratio = lambda name: F.col(name) / words
    return {
        "symbols_per_word": ratio("n_symbols"),
        "repeated_share": ratio("n_repeat_words"),
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length": ratio("word_chars"),
        "upper_runs_per_word": ratio("n_upper_runs"),
        "stops_per_word": ratio("n_stops"),
        "words": F.col("n_words").cast("double"),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.cut) if self.at_least else x < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules for rejection, in order; a text that none covers is kept."""

    rules: list[tuple[Term, ...]]

    def rejects(self) -> Column:
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for term in rule:
                test = test & term.column()
            out = F.when(test, True) if out is None else out.when(test, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules)


def _mask(rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x["bad"]), dtype=bool)
    for t in rule:
        out &= x[t.feature] >= t.cut if t.at_least else x[t.feature] < t.cut
    return out


def _part(x: dict[str, np.ndarray], mask: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[mask] for k, v in x.items()}


def _score(rule, x) -> float:
    hit = x["bad"][_mask(rule, x)]
    return float((2 * hit.sum() - len(hit)) / len(hit)) if len(hit) else -1.0


def _grow(x, names) -> tuple[Term, ...]:
    rule: tuple[Term, ...] = ()
    while len(rule) < MAX_TERMS and 0 < (p0 := int(x["bad"].sum())) < (n0 := len(x["bad"])):
        before = math.log2(p0 / n0)
        best, gain = None, 1e-9
        for name in names:
            order = np.argsort(x[name], kind="stable")
            values, below = x[name][order], np.append(0, np.cumsum(x["bad"][order]))
            cuts = np.unique(values[[n0 * k // CUTS for k in range(1, CUTS)] + [n0 - 1]])
            for cut, at in zip(cuts, np.searchsorted(values, cuts), strict=True):
                low = int(below[at])
                for up, p, n in ((True, p0 - low, n0 - at), (False, low, int(at))):
                    if p and n < n0 and (g := p * (math.log2(p / n) - before)) > gain:
                        best, gain = Term(name, up, float(cut)), g
        if best is None:
            break
        rule += (best,)
        x = _part(x, _mask((best,), x))
    return rule


def learn(rows: list[dict]) -> DecisionList:
    """Sequential covering; rows hold the features and `bad`, in an order that does not depend on the run."""
    names = sorted(k for k in (rows[0] if rows else {}) if k not in ("bad", "key"))
    x = {k: np.array([r[k] for r in rows], dtype=float) for k in (*names, "bad")}
    third = np.arange(len(rows)) % 3 == 0
    grow, prune = _part(x, ~third), _part(x, third)
    rules: list[tuple[Term, ...]] = []
    while len(rules) < MAX_RULES and grow["bad"].any():
        rule = _grow(grow, names)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _score(r, prune))
        hit = prune["bad"][_mask(rule, prune)]
        if len(hit) < MIN_COVER or hit.sum() < PRECISION * len(hit):
            break
        rules.append(rule)
        grow, prune = (_part(part, ~_mask(rule, part)) for part in (grow, prune))
    return DecisionList(rules)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DecisionList:
    """From docs (doc_id, text) and labels (doc_id, quality: 1 good, 0 bad; null: left out)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("quality")).filter("key is not null and quality is not null")
    n = labels.count()
    share = min(1.0, sample / n) if n else 1.0
    chosen = labels.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("key").agg(F.min("quality").alias("quality"))
    some = docs.select(F.col("doc_id").cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # sample rows at most
    told = statistics(some).filter(~base_failed()).select("key", (1 - F.col("quality")).alias("bad"), *[c.alias(k) for k, c in features().items()])
    rows = sorted((r.asDict() for r in told.collect()), key=lambda r: (r["key"] * 2654435761 % (1 << 32), r["words"]))
    return learn(rows)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs without text, with the statistics, base_failed and kept."""
    told = statistics(docs, text).withColumn("base_failed", base_failed())
    return told.withColumn("kept", ~F.col("base_failed") & ~rules.rejects())

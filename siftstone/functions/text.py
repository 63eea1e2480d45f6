"""Text functions as Column expressions; Arrow UDFs only where Unicode normal forms or case folding are asked for."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry nothing in a clinical query.
STOP = (
    "have has had you your do does did are is was were a an the of in on to for or and with from it that this been ever currently recently somewhere feel like "
    "related reason consulting significantly experiencing significant way characterize how what when any members immediate yes no unknown not none nowhere pain "
    "precisely located fast appear intense right left r l"
).split()

# Concepts and the phrases that name them, in order of precedence.
ALIASES = {
    "shortness of breath": ("shortness of breath", "difficulty breathing", "dyspnea", "breathlessness"),
    "palpitations": ("palpitations", "heart racing", "racing heart"),
    "sweating": ("sweating", "diaphoresis"),
    "chest pain": ("chest pain", "chest tightness", "side of the chest"),
    "numbness tingling": ("numbness", "tingling", "paresthesia"),
    "detachment": ("detached from", "depersonalization", "derealization"),
    "choking": ("choking", "suffocating"),
    "fear of dying": ("feel like you are dying", "fear of dying"),
    "anxiety": ("anxiety", "anxious"),
    "depression": ("depression", "depressive"),
    "asthma": ("asthma", "bronchodilator"),
    "head trauma": ("head trauma", "head injury"),
    "fever": ("fever", "febrile"),
    "cough": ("cough", "coughing"),
    "wheezing": ("wheezing", "wheeze"),
    "fainting": ("fainting", "syncope", "loss of consciousness"),
    "vomiting": ("vomiting", "vomit"),
    "headache": ("headache", "headaches"),
}

# Openings of questions and what they become; the first that fits is applied.
OPENINGS = (
    (r"^Do you have\s+", ""),
    (r"^Do you feel\s+", ""),
    (r"^Have you ever had\s+", "ever had "),
    (r"^Have you recently had\s+", "recently had "),
    (r"^Have you\s+", ""),
    (r"^Are you\s+", ""),
    (r"^Is your\s+", ""),
    (r"^Do you\s+", ""),
    (r"^Characterize your\s+", ""),
)


def clean(text: Column) -> Column:
    """Runs of white space become one blank; trimmed. ASCII white space, as regular expressions of both engines have it."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Rows that are Python objects at a time; the rest of a batch is in Arrow's compact form.
_PIECE = 128


def _mapped(fn: Callable, kind: str, column: Column) -> Column:
    """fn over the values of a column that are not null, in Arrow batches."""
    made = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    def run(values: pa.Array) -> pa.Array:
        pieces = (values.slice(at, _PIECE).to_pylist() for at in range(0, len(values), _PIECE))
        return pa.concat_arrays([pa.array([], made), *(pa.array([None if x is None else fn(x) for x in piece], made) for piece in pieces)])

    return F.arrow_udf(run, kind)(column)


def clean_nfkc(text: Column) -> Column:
    """Compatibility normal form, then clean(), for all Unicode white space."""
    return _mapped(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()), "string", text)


def letters(text: Column) -> Column:
    """Runs of a to z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def search_tokens(text: Column) -> Column:
    """letters() without stop words and words under three letters; a plural s is taken off longer words."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda x: ~x.isin(STOP))
    plural = lambda x: (F.length(x) > 4) & x.endswith("s") & ~x.rlike("(ss|is|us)$")
    return F.transform(kept, lambda x: F.when(plural(x), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))


def word_set(text: Column) -> Column:
    return F.array_distinct(letters(text))


def _folded_words(x: str) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", folded)


def catalog_tokens(text: Column) -> Column:
    """Unicode words without case and accents."""
    return _mapped(_folded_words, "array<string>", text)


def alias_key(text: Column) -> Column:
    """Words of the case-folded compatibility form, joined by a blank."""
    return _mapped(lambda x: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", x).casefold())), "string", text)


def informative(words: Column, stop: list[str]) -> Column:
    """Distinct words that are neither stop words nor numbers."""
    return F.filter(F.array_except(words, F.array(*map(F.lit, stop))), lambda x: ~x.rlike(r"^\d+$"))


def plain_label(text: Column) -> Column:
    """The cleaned label; null where it is blank or holds a code such as E_12 or V_3."""
    tidy = clean(text)
    return F.when((tidy != "") & ~tidy.rlike(r"\b[EV]_\d+\b"), tidy)


def compact_question(text: Column) -> Column:
    """The question without its mark and its opening; negation, time and family clauses stay."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"[?:]+$", ""))
    out = None
    for pattern, put in OPENINGS:
        test, value = bare.rlike("(?i)" + pattern), F.regexp_replace(bare, "(?i)" + pattern, put)
        value = F.when(value == "", bare).otherwise(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(bare)


def positive(text: Column, numbers: str = r"^\d+$") -> Column:
    """Whether `question = answer` states something: not no, unknown, none or nowhere, and not a bare number."""
    answer = F.lower(F.trim(F.get(F.split(text, " = ", 2), 1)))
    return F.coalesce(~(answer.isin("no", "unknown", "none", "nowhere") | answer.rlike(numbers)), F.lit(True))


def concepts(text: Column) -> Column:
    """Names of the concepts a text mentions; without any, its first six distinct content words as one."""
    low = F.lower(text)
    named = F.array_compact(
        F.array(*[F.when(F.greatest(*[low.contains(a) for a in names]) if len(names) > 1 else low.contains(names[0]), F.lit(k)) for k, names in ALIASES.items()])
    )
    content = F.slice(F.array_distinct(F.filter(letters(text), lambda x: (F.length(x) > 2) & ~x.isin(STOP))), 1, 6)
    none = F.array().cast("array<string>")
    return F.when(~positive(text), none).when(F.size(named) > 0, named).when(F.size(content) > 0, F.array(F.array_join(content, " "))).otherwise(none)


def joined(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def excerpt(text: Column, limit: int = 4000) -> Column:
    """The first `limit` characters, ended at the last line break among them where there is one."""
    head = F.substring(text, 1, limit)
    cut = F.length(head) - F.instr(F.reverse(head), "\n")
    return F.when(F.length(text) <= limit, text).when(F.instr(head, "\n") > 0, head.substr(F.lit(1), cut)).otherwise(head)


def printable(text: Column, limit: int) -> Column:
    tidy = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.when(F.length(tidy) > limit, F.concat(F.substring(tidy, 1, limit), F.lit("..."))).otherwise(tidy)


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case and white space."""
    return F.lower(clean(a)) == F.lower(clean(b))


def contains_phrase(words: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in a row."""
    line = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(phrase) > 0) & line(words).contains(line(phrase))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def windows(text: Column, size: int = 180, stride: int = 150) -> Column:
    """Word windows, array of (index, text); the last one reaches the end. Null where there is no word."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / stride)).cast("int")
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), F.array_join(F.slice(words, i * stride + 1, size), " ").alias("text"))))

    # the words are bound to a name, so they are made once for a text and not for each window
    return F.get(F.transform(F.array(F.array_remove(F.split(clean(text), " "), "")), cut), 0)

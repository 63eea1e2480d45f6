"""JSON pointers over VARIANT values: a column of pointers walks a column of documents, step by step, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = """CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN try_cast(v AS map<string, variant>)[k]
WHEN schema_of_variant(v) LIKE 'ARRAY%' AND k RLIKE '^(0|[1-9][0-9]{0,8})$' THEN get(try_cast(v AS array<variant>), cast(k AS int)) END"""


def valid(pointer: Column) -> Column:
    """A pointer begins with a slash, and each ~ in it stands before 0 or 1."""
    return F.coalesce(pointer.startswith("/") & ~pointer.rlike("~(?![01])"), F.lit(False))


def resolve(document: str, pointer: str) -> Column:
    """The VARIANT at a pointer of a VARIANT column; null where there is none. Keys of objects may be any text, positions of arrays have no leading zero."""
    steps = f"transform(split(substring({pointer}, 2), '/', -1), k -> replace(replace(k, '~1', '/'), '~0', '~'))"
    return F.when(valid(F.col(pointer)), F.expr(f"aggregate({steps}, {document}, (v, k) -> {_STEP})"))


def quote_fault(document: str, pointer: str, excerpt: str) -> Column:
    """Why an excerpt does not stand in the string that a pointer leads to: invalid_pointer, unknown_pointer, not_a_string, not_quoted; null where it does.

    A blank excerpt is never quoted. A JSON null is a value that is no string.
    """
    at = resolve(document, pointer)
    kind = F.schema_of_variant(at)
    said = F.when(kind == "STRING", F.try_variant_get(at, "$", "string"))
    return (
        F.when(~valid(F.col(pointer)), "invalid_pointer").when(at.isNull(), "unknown_pointer").when(kind != "STRING", "not_a_string")
        .when((F.trim(F.col(excerpt)) == "") | ~F.coalesce(said.contains(F.col(excerpt)), F.lit(False)), "not_quoted")
    )

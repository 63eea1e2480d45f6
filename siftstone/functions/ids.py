"""Content-bound identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name space of URLs in RFC 4122.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """A name-based UUID, version 5: the first 16 bytes of SHA-1 with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(text: Column, prefix: str = "w:") -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(text), 1, 12))


def fingerprint(key: Column, payload: Column) -> Column:
    """Aggregate: SHA-256 over the payloads in order of their keys; independent of the order of rows."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), payload.alias("p"))))
    return F.sha2(F.array_join(F.transform(rows, lambda x: x["p"]), "\n"), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in order of their names, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def now_iso() -> Column:
    """The time of the query in UTC with its zone: for records alone, never in anything that is hashed."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")

"""Addresses: links in pages, canonical forms, licences, file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no file may bear.
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def bare(url: Column) -> Column:
    """Without query, fragment and trailing slash; https, lower-case host."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.concat(F.lit("https://"), host(url), F.regexp_replace(path, "/+$", ""))


def canonical(url: Column, hosts: list[str], prefix: str, allowed: str = r"^[A-Za-z0-9()_-]+$") -> Column:
    """The canonical address of a detail page, or null for other hosts, paths and unsafe topics (ASCII)."""
    topic = F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), r"\+", "%2B"), "/+$", ""))
    rest = F.substring(topic, len(prefix) + 1, 1 << 20)
    good = host(url).isin(hosts) & url.rlike("^https?://") & topic.startswith(prefix) & rest.rlike(allowed)
    return F.when(good, F.concat(F.lit("https://"), F.lit(hosts[0]), F.lit(prefix), rest))


def nfc(text: Column) -> Column:
    """Canonical composed form."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(text)


def file_name(topic: Column) -> Column:
    return F.concat(F.when(topic.rlike(RESERVED), F.lit("_")).otherwise(F.lit("")), topic, F.lit(".txt"))


def open_licence(url: Column) -> Column:
    """CC0, BY and BY-SA by their exact addresses; null for every other, so for NC and ND."""
    where = F.trim(url)
    path = F.regexp_replace(F.regexp_extract(where, r"^https?://(?:www\.)?creativecommons\.org(/[^?#]*)", 1), "/+$", "")
    pattern = r"^/licenses/(by|by-sa)/(1\.0|2\.0|2\.5|3\.0|4\.0)(/igo)?$"
    name = F.concat(F.lit("CC-"), F.upper(F.regexp_extract(path, pattern, 1)), F.lit("-"), F.regexp_extract(path, pattern, 2), F.when(path.endswith("/igo"), F.lit("-IGO")).otherwise(F.lit("")))
    return F.when(path == "/publicdomain/zero/1.0", F.lit("CC0-1.0")).when(path.rlike(pattern), name)

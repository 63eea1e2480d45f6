"""What SQL text can call: a table function of word windows and the text functions that are no expressions of Spark's own."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.session import ship
from siftstone.sources import html


class WordWindows:
    """word_windows(text, size, stride): (index, text) of each window of words; the last one reaches the end, a text without words has none."""

    def eval(self, text: str, size: int, stride: int) -> Iterator[tuple[int, str]]:
        words = (text or "").split()
        at = 0
        while words:
            yield at, " ".join(words[at * stride : at * stride + size])
            if at * stride + size >= len(words):
                return
            at += 1


def register(spark: SparkSession) -> SparkSession:
    """Registers word_windows for LATERAL, and normalize_nfkc, tokenize_catalog and html_sections as functions over Arrow batches."""

    def per_value(name: str, kind: str, fn) -> None:
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda x: None if x is None else fn(x))

        spark.udf.register(name, F.pandas_udf(run, kind))

    ship(spark)
    spark.udtf.register("word_windows", F.udtf(WordWindows, returnType="index int, text string"))
    per_value("normalize_nfkc", "string", lambda x: " ".join(unicodedata.normalize("NFKC", x).split()))
    per_value("tokenize_catalog", "array<string>", tx._folded_words)
    per_value("html_sections", "array<struct<title:string,text:string>>", lambda x: [{"title": a, "text": b} for a, b in html.read_sections(x)])
    return spark

"""Sources with explicit schemas: zipped CSV, JSON dictionaries, XML topics and articles, text catalogs, paged services.

Files are listed and opened by Spark's readers, so any store that Spark reads will do; what Spark has no format for is
taken as binary rows and parsed in Arrow batches. A bad row fails the read, but where errors are collected by contract.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "row_no long, age string, sex string, evidences string, initial_evidence string"
LABELS = "row_no long, pathology string, differential string"
_FIELDS = ["AGE", "SEX", "EVIDENCES", "INITIAL_EVIDENCE"]
_LABEL_FIELDS = ["PATHOLOGY", "DIFFERENTIAL_DIAGNOSIS"]


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def zipped_rows(files: DataFrame, split: str, fields: list[str], schema: str, limit: int | None = None) -> DataFrame:
    """Rows of the one member release_{split}_patients in each ZIP file (content), numbered from 1 in its file."""
    import csv

    names = [c.split()[0] for c in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.namelist() if re.fullmatch(rf"(?:.*/)?release_{split}_patients(?:\.csv)?", m)]
                    if len(members) != 1:
                        raise ValueError(f"one member release_{split}_patients expected, {len(members)} found")
                    with z.open(members[0]) as f:
                        reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                        if missing := [x for x in fields if x not in (reader.fieldnames or [])]:
                            raise ValueError(f"missing columns {missing}")
                        rows: list[tuple] = []
                        for n, row in enumerate(reader, 1):
                            if limit is not None and n > limit:
                                break
                            if any(row[x] is None for x in fields):
                                raise ValueError(f"row {n} has too few fields")
                            rows.append((n, *(row[x] for x in fields)))
                            if len(rows) == 4096:
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                                rows = []
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return files.select("content").mapInArrow(work, schema)


def zipped_cases(spark: SparkSession, path: str, split: str, limit: int | None = None) -> DataFrame:
    """Rows of the one member release_{split}_patients of a ZIP file, numbered from 1; columns of labels are not read."""
    return zipped_rows(binary(spark, path), split, _FIELDS, CASES, limit)


def zipped_labels(spark: SparkSession, path: str, split: str, limit: int | None = None) -> DataFrame:
    """The labels of the same rows: for evaluation alone."""
    return zipped_rows(binary(spark, path), split, _LABEL_FIELDS, LABELS, limit)


def case_columns(raw: DataFrame) -> DataFrame:
    """Adds age_years (digits or null) and sex_code (M, F or null)."""
    sex = F.upper(F.trim("sex"))
    return raw.withColumn("age_years", F.when(F.trim("age").rlike(r"^\d+$"), F.trim("age").cast("int"))).withColumn("sex_code", F.when(sex.isin("M", "F"), sex))


def dictionary(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of a JSON object whose values are all objects of the DDL `value`; anything else fails."""
    text = spark.read.text(path, wholetext=True)
    told = F.from_json("value", f"map<string, struct<{value}>>", {"mode": "FAILFAST"})
    return text.select(F.explode(told).alias("key", "value")).select("key", F.when(F.col("value").isNull(), F.raise_error(F.lit("a value that is not an object"))).otherwise(F.col("value")).alias("value"))


def evidence_dimensions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(code, question, data_type, is_antecedent) and (code, raw, meaning) of an evidence dictionary."""
    d = dictionary(spark, path, "question_en string, data_type string, is_antecedent boolean, value_meaning map<string, struct<en: string>>")
    dim = d.select(F.col("key").alias("code"), F.col("value.question_en").alias("question"), "value.data_type", "value.is_antecedent")
    values = d.select(F.col("key").alias("code"), F.explode("value.value_meaning").alias("raw", "m")).select("code", "raw", F.col("m.en").alias("meaning"))
    return dim, values


def topics(spark: SparkSession, path: str, titles: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable English topics (id, title, url, language, summary) of a topic file, and one row of counts.

    A repeated id among them fails when the topics are read.
    """
    schema = "_id long, _title string, _url string, _language string, `full-summary` string"
    raw = spark.read.format("xml").schema(schema).option("rowTag", "health-topic").option("ignoreNamespace", "true").option("mode", "FAILFAST").load(path)
    d = raw.select(F.col("_id").alias("id"), F.col("_title").alias("title"), F.col("_url").alias("url"), F.col("_language").alias("language"), F.trim("full-summary").alias("summary"))
    english = F.col("language").isin("English", "en")
    wanted = F.col("title").isin(titles) if titles else F.lit(True)
    has = F.coalesce(F.col("summary") != "", F.lit(False))
    counts = d.agg(
        F.count("*").alias("total"), F.count_if(english).alias("english"), F.count_if(~english).alias("other_language"), F.count_if(english & ~wanted).alias("not_wanted"),
        F.count_if(english & wanted & ~has).alias("without_summary"), F.count_if(english & wanted & has).alias("parsed"),
    )
    from pyspark.sql.window import Window

    good = d.filter(english & wanted & has).withColumn("__n", F.count("*").over(Window.partitionBy("id")))
    checked = good.withColumn("id", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("topic id repeated: "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("id")))
    return checked.drop("__n"), counts


# Elements of articles that are not running text.
_OUTSIDE = {"fig", "table-wrap", "ref-list", "supplementary-material"}


def _article(content: bytes) -> tuple:
    import xml.etree.ElementTree as ET

    root = ET.fromstring(content)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else e.tag

    def text(e) -> str:
        return " ".join("".join(e.itertext()).split())

    def paragraphs(e) -> list[str]:
        if e.tag in _OUTSIDE:
            return []
        return [text(e)] if e.tag == "p" else [x for child in e for x in paragraphs(child)]

    ids = {e.get("pub-id-type"): text(e) for e in root.iter("article-id")}
    licence = next((v for e in root.iter("license") for k, v in e.attrib.items() if k.endswith("href")), None)
    found = [(name, x) for name in ("abstract", "body") for e in root.iter(name) for x in paragraphs(e) if x]
    if not (title := next((text(e) for e in root.iter("article-title")), "")) or not found:
        raise ValueError("an article without title or text")
    return ids, title, licence, [{"title": a, "text": b} for a, b in found]


ARTICLES = "path string, ids map<string,string>, title string, licence string, sections array<struct<title:string,text:string>>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    return article_rows(binary(spark, path, "*.xml"))


def article_rows(files: DataFrame) -> DataFrame:
    """Journal articles of binary rows (path, content): identifiers, title, licence address, and paragraphs of abstract and body without figures, tables and references."""
    shape = pa.schema([("path", pa.string()), ("ids", pa.map_(pa.string(), pa.string())), ("title", pa.string()), ("licence", pa.string()), ("sections", pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):  # so many rows are Python objects at a time
            rows = [(p, *_article(c)) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((r[0], list(r[1].items()), *r[2:]) for r in rows), strict=True), shape, strict=True)], schema=shape)

    return files.select("path", "content").mapInArrow(work, ARTICLES)


def bounded(files: DataFrame, most: int) -> DataFrame:
    """Binary rows; one of more than `most` bytes fails the read and is never cut."""
    return files.filter(F.when(F.col("length") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("file too large: "), F.col("path"))).cast("boolean")))


def inventory(files: DataFrame) -> DataFrame:
    """path, length, sha256 of binary rows."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def utf8(files: DataFrame) -> DataFrame:
    """path, text of binary rows; bytes that are not UTF-8, and empty files, fail the read."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")) & (F.trim(F.col("content").cast("string")) != ""), F.col("content").cast("string"))
    return files.select("path", F.coalesce(text, F.raise_error(F.concat(F.lit("no text in "), F.col("path"))).cast("string")).alias("text"))


def headed_text(text: Column) -> Column:
    """(topic, title, url, kind, body) of a text of four header lines, a rule of = and a body."""
    part = F.split(text, "\n", 6)
    value = lambda i: F.trim(F.regexp_replace(F.get(part, i), r"^[^:]*:\s*", ""))
    good = (F.size(part) == 6) & F.get(part, 4).rlike("^=+$")
    return F.when(good, F.struct(value(0).alias("topic"), value(1).alias("title"), value(2).alias("url"), value(3).alias("kind"), F.get(part, 5).alias("body")))


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good entries, the first of each (url, file), and faults (path, fault): bad entries are told, good ones stay."""
    from siftstone.operators.ranking import first_of

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), headed_text(F.col("value")).alias("e"))
    fault = F.when(F.col("e").isNull(), "header").when((F.col("e.topic") == "") | (F.col("e.url") == ""), "blank")
    told = rows.withColumn("fault", fault)
    good = told.filter("fault is null").select("path", "e.*")
    return first_of(good, ["url"], [F.asc("path")]), told.filter("fault is not null").select("path", "fault")


def index_of(texts: DataFrame) -> DataFrame:
    """topic, title, url, file of headed texts (path, value) whose file name is that of their topic: the index made anew from the files alone."""
    from siftstone.functions.urls import file_name

    e = headed_text(F.col("value"))
    rows = texts.select(F.element_at(F.split("path", "/"), -1).alias("file"), e.alias("e")).filter("e is not null")
    good = rows.filter((F.col("e.topic") != "") & (F.col("e.url") != "") & (F.col("file") == file_name(F.col("e.topic"))))
    return good.select("e.topic", "e.title", "e.url", "file").orderBy(F.lower("topic"), "url")


def script_setting(html: Column, name: str) -> Column:
    """The number or quoted value that a page's scripts hand to the function `name`; scripts are read and never run. Null where there is none."""
    call = rf"<script[^>]*>(?:(?!</script>).)*?\b{re.escape(name)}\(\s*[\"']?([^\"')\s]*)"
    found = F.regexp_extract(html, "(?is)" + call, 1)
    return F.when(found != "", F.regexp_replace(found, "&amp;", "&"))


def location(given: str | None, variable: str, project: str, workspace: str, marker: str) -> str:
    """Where local data lie: as given, else as the environment variable says, else in the project if the marker file is there, else in the workspace."""
    import os

    if given is not None:
        return os.path.abspath(os.path.expanduser(given))
    if told := os.environ.get(variable):
        return os.path.abspath(os.path.expanduser(told))
    return project if os.path.isfile(os.path.join(project, marker)) else workspace


def vignette(text: Column, headings: list[str]) -> Column:
    """Array of (section, pos, line) of a headed note: bullets of each section as they stand; lines before the first heading go."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<section:string,pos:int,line:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = F.regexp_replace(x, ":$", "")
        item = F.struct(acc["now"].alias("section"), F.size(F.filter(acc["out"], lambda o: o["section"] == acc["now"])).alias("pos"), F.regexp_replace(x, r"^[-*]\s*", "").alias("line"))
        kept = F.when(acc["now"] != "", F.concat(acc["out"], F.array(item))).otherwise(acc["out"])
        return F.when(name.isin(headings), F.struct(name.alias("now"), acc["out"].alias("out"))).otherwise(F.struct(acc["now"].alias("now"), kept.alias("out")))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema, each with the hash of its line."""
    text = spark.read.text(path)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.sha2("value", 256).alias("row_sha")).select("r.*", "row_sha")


def paged(spark: SparkSession, fetch, page: int = 100, most_pages: int = 1000) -> DataFrame:
    """Rows of a paged service as a Python data source: one partition for each page.

    fetch(top, skip) -> (total, [json text]); the total must stay what it was, and pages may not repeat.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    total, _ = fetch(0, 0)
    if -(-total // page) > most_pages:
        raise ValueError(f"more than {most_pages} pages")

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(at) for at in range(0, total, page)] or [InputPartition(0)]

        def read(self, partition):
            now, rows = fetch(page, partition.value)
            if now != total:
                raise ValueError(f"the total changed from {total} to {now}")
            for i, row in enumerate(rows):
                yield partition.value + i, row

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "siftstone_paged"

        def schema(self):
            return "position long, json string"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format("siftstone_paged").load()

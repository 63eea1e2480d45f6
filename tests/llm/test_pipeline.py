import subprocess
import sys

import corpus_pipeline
from siftstone.llm import queries
from siftstone.llm.common import stored


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.schema.names == docs.schema.names, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}, name
        before = after
    assert after.count() > 0.5 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).select("doc_id").distinct().count() == after.count()


def test_clean_documents_stay_and_copies_go(spark, sf):
    text = [" ".join(f"word{(i * 37 + j * 11) % 5000}" for j in range(120)) for i in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)] + [(10, text[0], "en", "s", 1), (11, text[1] + " tail", "en", "s", 1), (None, text[2] + "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == {0, 1, 2, 3, 4, 5} or kept == {0, 1, 2, 3, 4, 5, None}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()} >= {0, 1, 2, 3, 4, 5}


CLASHES = ["__row", "__rest", "__h", "__i", "__has", "__hash", "__id", "__th", "__spans", "kept", "score", "lang_pred", "n_words", "node", "component", "n_shingles", "component_id"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def distinct(k, n=120):
    return " ".join(f"word{(k * 37 + j * 11) % 5000}x{k}" for j in range(n))


def wide(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], SHAPE + "".join(f", `{c}` string" for c in CLASHES))


def test_a_copy_takes_no_other_text_of_its_id_along(spark, sf):
    c, a = distinct(1), distinct(2)
    docs = wide(spark, [(3, c, "en", "s", 1), (5, a, "en", "s", 1), (5, c + " tail", "en", "s", 1)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [(3, c), (5, a)]


def test_one_document_of_each_group_stays_whatever_its_id(spark, sf):
    texts = [distinct(k) for k in range(4)]
    rows = [(None, texts[0], "en", "s", 1)] * 3 + [(None, texts[0] + " more", "en", "s", 1)]  # no id at all in the group
    rows += [(8, texts[1], "en", "s", 1), (8, texts[1].upper(), "en", "t", 1), (None, texts[1], "en", "s", 1)]  # one id twice, and none
    rows += [(9, texts[2], None, None, None), (9, texts[2], None, None, None)]  # repeated rows
    rows += [(10, "", "en", "s", 0), (11, "", "en", "s", 0), (12, None, "en", "s", 0), (12, " \n", "en", "s", 2)]  # nobody's copies
    got = corpus_pipeline.near_dedup(spark, wide(spark, rows), sf).collect()
    left = sorted((repr(r.doc_id), (r.text or "").lower()[:20]) for r in got)
    want = sorted([("None", texts[0][:20]), ("8", texts[1][:20]), ("9", texts[2][:20]), ("10", ""), ("11", ""), ("12", ""), ("12", " \n")])
    assert left == want and all(r.__getitem__("kept") == "clash" for r in got)


def test_stages_keep_columns_that_clash_and_take_empty_tables(spark, sf, tmp_path):
    run = distinct(77, 60)
    rows = [(i, distinct(i) + "\n" + run, "en" if i % 3 else None, "s", 1) for i in range(8)] + [(20, None, None, None, None), (21, "", "", "", 0), (None, distinct(30, 20_000), "en", "s", 1)]
    docs = wide(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(r[c] == "clash" for r in got for c in CLASHES), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert sum(run in r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()) == 1
    # the pipeline over tables without rows, and over nulls alone
    for k, given in enumerate(([], [(1, None, None, None, None), (None, "", None, None, None)])):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame(given, SHAPE).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        assert corpus_pipeline.run(spark, at).collect() == []


def test_the_pipeline_is_its_stages(spark, sf):
    """run() over the smallest tables: documents of every kept stage, each token of the last one's documents in one piece."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "test")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == ids
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_queries_are_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_the_rest_does_not_import_the_subpackage():
    code = "import sys; import siftstone.plans.registry, siftstone.sources.readers, siftstone.streaming.events; assert not any(m.startswith('siftstone.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)

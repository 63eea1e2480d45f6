"""The registered queries on the smallest tables: columns and types of the contracts, and rows held against plain Python."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest

from siftstone.llm import queries
from siftstone.llm.queries import vocabulary

from .test_documents import brute_lines, brute_signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name, types):
    df = queries.QUERIES[name](spark, sf)
    assert df.dtypes[: len(types)] == types or {*types} <= {*df.dtypes}, df.dtypes
    return df.collect()


def lowered(text):
    return text.encode().lower().decode()


def test_op1(spark, sf, texts):
    got = run(spark, sf, "op1_near_dedup", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    sets = {i: (lambda w: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())(WORD.findall(lowered(t))) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if v == hi else v for i, v in label.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in texts} and len(got) == len(texts)


def test_op2(spark, sf, texts):
    types = [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    got = {r.doc_id: r for r in run(spark, sf, "op2_fingerprints", types)}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if len(t) < 3000:
            assert got[i].fingerprint == "".join(f"{x:04x}" for x in brute_signature(t)) and got[i].edited_fingerprint == "".join(f"{x:04x}" for x in brute_signature(edited))


def test_op3(spark, sf, texts):
    types = [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    got = run(spark, sf, "op3_packing", types)
    library = __import__("tokenizers").Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = [sum(r.length for r in rows) for rows in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding <= 0.01 * sum(used)


def test_op5(spark, sf, texts):
    got = run(spark, sf, "op5_token_counts", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")])
    library = __import__("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), want[i], want[i] > 1024) for i, t in texts.items()}


def test_op6(spark, sf, texts):
    got = queries.op6_sentencepieces(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(r.lossless for r in got)


def test_op7(spark, sf, texts):
    types = [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = {r.doc_id: r for r in run(spark, sf, "op7_lm_scoring", types)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*WORD.findall(lowered(t)), None] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = count.total(), len(count)
    assert sorted(got) == sorted(texts)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n) and r.base_score == pytest.approx(base, rel=1e-9)
    # no text is free, and what was learned from costs less a byte than what was not
    cost = {k: sum(-r.score for r in got.values() if r.held_out == k) / sum(len(texts[i]) for i, r in got.items() if r.held_out == k) for k in (True, False)}
    assert all(r.score < 0 for r in got.values()) and cost[False] < cost[True]


def test_op8(spark, sf, texts):
    types = [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")]
    got = {r.doc_id: r for r in run(spark, sf, "op8_quality_rules", types)}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = len({j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (k, k + 1, k + 2)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed)
        assert not (failed and r.kept)


def test_op9(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in run(spark, sf, "op9_html_extraction", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")])}
    assert sorted(got) == sorted(pages)
    for k, page in pages.items():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page.html or "", re.S)
        blocks = re.split(r"</?(?:p|br|h1|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->", "", inside[1], flags=re.S)) if inside else []
        want = " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)))
        assert got[k].text == want and got[k].n_chars == len(want) and got[k].url == page.url


def test_op10(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op10_line_dedup(spark, sf).collect()}
    assert {i: r.text or "" for i, r in got.items()} == dict(brute_lines(list(texts.items()), 50))
    for i, t in texts.items():
        assert got[i].n_lines - got[i].n_removed == (len((got[i].text or "").split("\n")) if got[i].text else 0) or not t or got[i].text == ""


def test_every_query_has_a_name_of_the_list():
    assert sorted(queries.QUERIES) == sorted([*(f"op{n}_{x}" for n, x in enumerate("near_dedup fingerprints packing language_id token_counts sentencepieces lm_scoring quality_rules html_extraction line_dedup periodic_runs top_products source_divergence".split(), 1)), "pipeline"])

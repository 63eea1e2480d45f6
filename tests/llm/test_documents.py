"""The document operators against brute force on small tables, with nulls, empty, long, tied and repeated rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from siftstone.llm import fingerprints, language_id, line_dedup, lm_scoring, near_dedup, packing, quality_rules, sentencepieces, token_counts
from siftstone.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, row string, node string, score string, n_words string"


def words(rng, n, common=40):
    return " ".join(rng.choice(["the", "of", "in"]) if rng.random() < 0.2 else "w%d" % rng.randrange(common) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = words(rng, 300, 4000)
    near = base.split()
    near[150] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "two words"), (9, "Über naïve Straße — 日本語 text <|endoftext|> x"),
        (10, words(rng, 6000)), (11, "a " * 500), (12, "line one is here\n" * 30), (12, "line one is here\n" * 30), (13, "▁ literal ▁▁ block"), (None, "no id " * 20),
        (14, "\x1c odd\x1dspace  double  space\r\nend "), (15, "x" * 300),
    ]
    out += [(20 + i, words(rng, 80, 500)) for i in range(30)]
    para = words(rng, 60, 5000)
    out += [(60 + i, words(rng, 30, 5000) + "\n" + para + "\n" + words(rng, 10, 5000)) for i in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none, rows):
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for v, (i, _) in zip(label, sets):
        least[v] = i if v not in least or least[v] is None else least[v] if i is None else min(least[v], i)
    want = sorted((repr(i), len(s), repr(least[v])) for v, (i, s) in zip(label, sets))
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_find_chains_and_large_groups(spark):
    rng = random.Random(3)
    base = words(rng, 200, 9000).split()
    texts = []
    for i in range(150):  # copies of one text, each with three words changed: a quarter of the pairs is linked
        t = list(base)
        for _ in range(3):
            t[rng.randrange(200)] = "z%d" % rng.randrange(10**6)
        texts.append((i, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in texts]
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_near_duplicates_link_versions_by_an_original_of_any_id(spark):
    rng = random.Random(11)
    base = ["w%d" % k for k in range(400)]
    texts = []
    for i in range(120):  # every version is linked to the original and to no other version
        t = list(base)
        for k in rng.sample(range(0, 400, 4), 0 if i == 70 else 10):
            t[k] = "z%d" % rng.randrange(10**9)
        texts.append((i, " ".join(t)))
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in texts]
    linked = [{b for b in range(120) if b != a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])} for a in range(120)]
    assert all(linked[a] == {70} for a in range(120) if a != 70)
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80).collect()
    assert len(got) == 120 and {r.component_id for r in got} == {0}


def test_every_pair_of_a_bucket_is_tried_once_it_is_needed(spark):
    rows = [("k", (i, bytes([i])), 100, 40, (i, bytes([i])), [0] * 16) for i in range(40)]
    live = spark.createDataFrame(rows, "key string, v struct<rep: bigint, node: binary>, n long, members long, label struct<rep: bigint, node: binary>, bits array<long>")
    seen, tried, centres = set(), 0, 8
    while not (live := near_dedup.untried(live, tried)).isEmpty():
        seen |= {(r.a.rep, r.b.rep) for r in near_dedup.across(live, centres, 80).collect()}
        tried, centres = centres, centres * near_dedup.GROWTH
    assert seen == {(a, b) for b in range(40) for a in range(b)} and tried >= 32


@pytest.mark.parametrize("changed, seed", [(4, 3), (4, 8), (5, 1)])
def test_sparse_groups_lose_no_link(spark, changed, seed):
    """Copies of one text with some words changed in each, of which few pairs are linked though most share buckets."""
    rng = random.Random(seed)
    base = words(rng, 200, 9000).split()
    texts = []
    for i in range(150):
        t = list(base)
        for _ in range(changed):
            t[rng.randrange(200)] = "z%d" % rng.randrange(10**6)
        texts.append((i, " ".join(t)))
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in texts]
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    assert 50 < len(set(label)) and {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 5, 50, 400, 5000):
        for share in (0, 0.05, 0.3, 1):
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            v = np.where(rng.random(n) < share, rng.integers(0, 1 << 64, n, dtype=np.uint64), u)
            differ = near_dedup.sketch(np.unique(u)) ^ near_dedup.sketch(np.unique(v))
            assert sum(int(x).bit_count() for x in differ.view(np.uint64)) <= len(np.setxor1d(u, v))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([((i, bytes([i])), (i + 1, bytes([i + 1]))) for i in range(40)], "a struct<rep: bigint, node: binary>, b struct<rep: bigint, node: binary>")
    got = near_dedup.components(edges).collect()
    assert len(got) == 41 and {r.label.rep for r in got} == {0}


def test_signature_is_that_of_a_minwise_hash():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:40], rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)]))
        agree.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
    assert abs(np.mean(agree) - 0.5) < 0.03  # 40 of 80


def test_fingerprints(spark, docs, none, rows):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    known = {i: t or "" for i, t in rows if i is not None}
    order = sorted((i for i in known if i not in (12,)), reverse=True)
    assert order
    for r in got:
        if r.doc_id is not None:
            assert r.n_chars == len(known[r.doc_id])
            by[known[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.fingerprints(none).count() == 0
    simple = [(i, "word%d " % i * (i + 3)) for i in range(1, 40)]
    told = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(simple, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(simple):
        nxt = simple[k - 1][1]
        e = len(t) // 3
        assert told[i].edited_sha256 == hashlib.sha256((t[: len(t) - e] + nxt[:e]).encode()).hexdigest()


def chained(*values):
    """Spark's xxhash64 over strings and longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_signature(text):
    """Order MinHash by its definition: for each mark the two elements that come first after it on the ring, hashed in text order."""
    tokens = regex.findall(fingerprints._TOKEN, text)
    if not tokens:
        return []
    low, seen, elements = (1 << 26) - 1, collections.Counter(), []
    for i in range(max(1, len(tokens) - 1)):
        k = chained(*tokens[i : i + 2]) >> 26
        seen[k] += 1
        later = seen[k] - 2  # the first occurrence is the k-mer itself, later ones have their number in the hash
        elements.append((k if later < 0 else chained_int(k, later) >> 26, i + 1))
    ring = sorted((h << 26 | p) for h, p in elements)
    out = []
    for i in range(64):
        mark = (i - 32) << 58
        at = sum(e < mark for e in ring)
        two = [ring[(at + j) % len(ring)] for j in range(2)]
        two.sort(key=lambda e: e & low)
        out.append(chained(two[0] >> 26, two[1] >> 26) & 0xFFFF)
    return out


def chained_int(value, number):
    h = xxhash.xxh64_intdigest(number.to_bytes(4, "little", signed=True), seed=xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed=42))
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("range_rows", [1, 4, 1000])
def test_fingerprints_equal_brute_force(spark, monkeypatch, range_rows):
    """All columns, over many ranges, with repeated and null ids and repeated rows."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    rows = [(i, words(rng, rng.randrange(0, 60), 30)) for i in range(-20, 40)] + [(7, words(rng, 30)) for _ in range(12)] + [(None, words(rng, 12)) for _ in range(12)]
    rows += [(3, "same same text"), (3, "same same text"), (None, None), (None, None), (None, "日本語 ab " * 9), (50, "one"), (51, "ab " * 40)]
    keyed = [(i, t or "") for i, t in rows]
    keyed.sort(key=lambda x: (x[0] is None, -(x[0] or 0), chained(x[1])))

    def alike(a, b):
        return sum(x == y for x, y in zip(a, b)) / 64 if a and b else float(a == b)

    def told(s):
        return "".join(f"{x:04x}" for x in s)

    want = []
    for k, (i, t) in enumerate(keyed):
        nxt = keyed[(k + 1) % len(keyed)][1]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = brute_signature(t), brute_signature(e), brute_signature(nxt)
        want.append((repr(i), len(t), hashlib.sha256(e.encode()).hexdigest(), told(a), told(b), alike(a, b), alike(a, c)))
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == sorted(want)
    if range_rows == 4:
        ranges = fingerprints.bounds_of(spark.createDataFrame(keyed, "doc_id long, text string").withColumn("__tie", F.xxhash64("text")))
        assert len(ranges) > 8 and len({k for k in ranges if k[0] == 1}) > 0


def test_a_row_alone_is_its_own_neighbour(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(None, "abc def ghi")], "doc_id long, text string")).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def test_fingerprints_feel_order(spark):
    rng = random.Random(5)
    w = [f"t{i}" for i in range(400)]
    moved = w[200:] + w[:200]
    mixed = w[:]
    rng.shuffle(mixed)
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(moved)), (3, " ".join(mixed))], "doc_id long, text string")
    s = {r.doc_id: np.array(r.s) for r in fingerprints.signature(d, "text", "s").collect()}
    same, turned, none_ = (s[1] == s[1]).mean(), (s[1] == s[2]).mean(), (s[1] == s[3]).mean()
    assert same == 1 > turned > none_ + 0.1  # half of the pairs keep their order when halves swap


def reference_ids(rows):
    t = __import__("tokenizers").Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for _, x in rows]


def test_packing(docs, none, rows):
    got = packing.pack(docs, packing.word_bpe(vocabulary("word_bpe_49k.json")), with_ids=True).collect()
    want = collections.Counter((i, ids.tobytes()) for (i, _), ids in zip(rows, reference_ids(rows)))
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, some in parts.items():
        if i != 12:  # two rows of one id
            some.sort(key=lambda r: r.start)
            whole = np.array([x for r in some for x in r.ids], dtype="<u4")
            assert want[(i, whole.tobytes())] == 1 and {r.doc_tokens for r in some} == {len(whole)}
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0) and len(s) <= 512
    assert packing.pack(none, packing.word_bpe(vocabulary("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 64, 16), (32, 1, 32), (128, 3, 20)])
def test_packer_keeps_limits_and_every_token(limits):
    rng = random.Random(sum(limits))
    packer = packing.VectorPacker(*limits, pool=8)
    items = [(k, np.arange(n, dtype="<u4"), rng.randrange(n + 1)) for k in range(200) for n in [rng.choice([1, 2, 5, 30, 90, 300])]]
    bins = [b for k, ids, loss in items for b in packer.add(k, ids, loss)] + list(packer.finish())
    seen = collections.defaultdict(list)
    for b in bins:
        total = sum(n for _, _, n in b)
        assert total <= limits[0] and len(b) <= limits[1]
        assert sum(max(0, s + n - max(s, len(i.ids) - i.loss)) for i, s, n in b) <= limits[2]
        assert total == limits[0] or total & (total - 1) == 0
        for i, s, n in b:
            seen[i.doc].append((s, n))
    for k, ids, _ in items:
        at = 0
        for s, n in sorted(seen[k]):
            assert s == at
            at += n
        assert at == len(ids)


def test_word_encoder_equals_the_library():
    from siftstone.llm.wordbpe import WordEncoder

    e, rng = WordEncoder(vocabulary("word_bpe_49k.json"), cache=50), random.Random(2)
    texts = ["Don't STOP <|startoftext|> now!! ﬁne Ǆ İ ß µ 12,345 a_b", "été ª º × ÷", ""] + ["".join(rng.choice("abcdeé .,!?'1\nßÄ") for _ in range(200)) for _ in range(60)]
    for t, ids in zip(texts, reference_ids([(0, t) for t in texts])):
        assert e.encode(t).tolist() == ids[:-1].tolist(), t


def test_token_counts(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    counter = token_counts.byte_bpe(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted((repr(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    got = token_counts.count_tokens(docs, counter).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(none, counter).count() == 0


def test_pretokens_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), random.Random(4)
    counter = token_counts.byte_bpe(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    cutter = token_counts.Cutter(counter.cut, size=50)
    for _ in range(400):
        x = "".join(rng.choice(["a", "b ", "  ", "\n", "\t", " ", "\u3000", "'s", "don't", "1", "é", "日", "\u0558", "𐥁", "word,", "<|endoftext|>", "<|", "\x1c", "\x85", "!", "\r\n"]) for _ in range(30))
        want = collections.Counter()
        for part in regex.split(r"(<\|endoftext\|>)", x):
            if part == "<|endoftext|>":
                want[part] += 1
            else:
                want.update(part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part))
        found = cutter.frequencies(x)
        assert found == want, repr(x)
        assert sum(f * counter.count(p) for p, f in found.items()) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    assert len(cutter) <= 50 and set(cutter.frequencies("word, word. word")) == {"word", " word", ",", "."}


def test_long_pretokens_are_counted_once_in_a_task():
    seen = []
    long = token_counts.LongCounts(lambda p: seen.append(p) or len(p), size=2)
    assert [long.of(x * 70) for x in "aabab"] == [70] * 5 and len(seen) == 2
    assert long.of("c" * 70) == 70 and len(long) == 1  # full, so it began anew


def test_language_id(spark, docs, none, rows):
    rng = random.Random(1)
    lex = {"aa": ["lala", "mimi", "kolo"], "bb": ["stra", "grund", "zwei"]}
    train = [(i, " ".join(rng.choice(lex[k]) for _ in range(20)), k) for i in range(60) for k in [rng.choice(list(lex))]]
    model = language_id.train(spark.createDataFrame([*train, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    test = spark.createDataFrame([(1, "lala kolo mimi"), (2, "Grund zwei"), (3, None), (4, "123 !?"), (5, ""), (6, "stra " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "bb"] and got[3][1] == 0.0
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(docs, language_id.train(none)).filter("lang_pred != 'und'").count() == 0
    assert language_id.predict(none, model).count() == 0 and language_id.predict(docs, model).count() == len(rows)


def test_long_text_scores_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = ["abc def ghi " * 9, "x", "zz yy " * 30]
    whole = language_id.score_texts(model, texts)
    monkeypatch.setattr(language_id, "PIECE", 7)
    parts = language_id.score_texts(model, texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_lm_scoring(spark, none, rows):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, t, (i or 0) % 5 != 1) for i, t in rows], "doc_id long, text string, training boolean")
    got = lm_scoring.score(d, F.col("training"), ["doc_id"]).collect()
    K, texts = lm_scoring.ORDER, [(i, (t or "").encode().lower().split(), (i or 0) % 5 != 1) for i, t in rows]
    count, trie = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(K + 1)]
    symbols = lambda w: [255] * K + list(b" ".join(w)) + [256]
    for _, w, training in texts:
        if training:
            count.update(w)
            count["end"] += 1
            b = symbols(w)
            for p in range(K, len(b)):
                for j in range(K + 1):
                    trie[j][tuple(b[p - j : p])][b[p]] += 1
    N, V = sum(count.values()), len(count)

    def code(context, s):
        out, gone = 0.0, set()
        for j in range(K, -1, -1):
            node = trie[j].get(tuple(context[K - j :]))
            if node is None:
                continue
            n, fresh = sum(c for x, c in node.items() if x not in gone), [x for x in node if x not in gone]
            if s in node:
                return out + math.log10((node[s] - 0.5) / n)
            if fresh:
                out += math.log10(len(fresh) / 2 / n)
            gone |= set(node)
        return out - math.log10(max(1, 257 - len(gone)))

    want = []
    for i, w, _ in texts:
        base = sum(math.log10((count[x] + 0.5) / (N + 0.5 * (V + 1))) for x in [*w, "end"])
        b = symbols(w)
        want.append((repr(i), len(w) + 1, sum(x in count for x in w) + 1, N, base, sum(code(b[p - K : p], b[p]) for p in range(K, len(b)))))
    for a, b in zip(sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5)
    assert lm_scoring.score(none.select("doc_id", "text"), F.lit(True), ["doc_id"]).count() == 0


def test_code_lengths_are_a_distribution(spark):
    """Over all symbols after a context the probabilities sum up to one."""
    text = ["abracadabra", "abba", "cab"]
    d = spark.createDataFrame([(t, True) for t in text], "text string, training boolean")
    seen = lm_scoring.gather(d).collect()
    contexts = {r.g >> 9 for r in seen}
    have = {r.g: r.t for r in seen}
    grid = spark.createDataFrame([(c << 9 | s, 1, have.get(c << 9 | s, 0)) for c in contexts for s in range(257)], "g long, n long, t long")
    total = collections.Counter()
    for r in lm_scoring.code_lengths(grid).collect():
        total[r.g >> 9] += 10**r.lp
    assert all(v == pytest.approx(1.0, abs=1e-9) for v in total.values())


def test_quality_statistics(docs, none, rows):
    import re

    d = docs.select("doc_id", "text")
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((repr(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    got = quality_rules.judge(d, quality_rules.DecisionList([])).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept != r.base_failed for r in got)
    assert quality_rules.judge(none.select("doc_id", "text"), quality_rules.DecisionList([])).count() == 0


def test_rules_are_learned_and_kept_apart(spark):
    rng = random.Random(9)
    good = [(i, words(rng, 120, 3000), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(x + "###" for x in words(rng, 120, 3000).split()), 0) for i in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    rules = quality_rules.train(d, d.select("doc_id", "quality"))
    assert "symbols_per_word" in str(rules)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(d.select("doc_id", "text"), rules).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    assert quality_rules.train(d, d.select("doc_id", "quality").filter("quality = 1")).rules == []


def test_line_dedup(docs, none, rows):
    got = line_dedup.dedup_lines(docs, 20, with_counts=True).collect()
    assert len(got) == len(rows) and {"row", "node", "score", "lang"} <= set(got[0].asDict())
    from siftstone.llm.line_dedup import dedup_lines

    want = brute_lines([(i, t) for i, t in rows if i is not None], 20)
    for r in got:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id], r.doc_id
    assert dedup_lines(none, 20).count() == 0


def brute_lines(rows, least):
    rows = sorted({(i, t) for i, t in rows if t is not None})
    units = [(i, [x for x in t.split("\n") if x.encode().split()]) for i, t in rows]
    out = {i: None for i, _ in rows}
    for a, (i, u) in enumerate(units):
        gone = set()
        for k in range(len(u)):
            for b in range(a + 1):
                v = units[b][1]
                for q in range(len(v)):
                    if v[q] != u[k] or (b, q) >= (a, k):
                        continue
                    lo = hi = 0
                    while k - lo > 0 and q - lo > 0 and u[k - lo - 1] == v[q - lo - 1]:
                        lo += 1
                    while k + hi + 1 < len(u) and q + hi + 1 < len(v) and u[k + hi + 1] == v[q + hi + 1]:
                        hi += 1
                    if sum(len(x.encode().split()) for x in u[k - lo : k + hi + 1]) >= least:
                        gone.update(range(k - lo, k + hi + 1))
        keep, n = [], -1
        for x in rows[a][1].split("\n"):
            if x.encode().split():
                n += 1
                if n in gone:
                    continue
            keep.append(x)
        out[i] = "\n".join(keep)
    return collections.defaultdict(lambda: None, out)


def test_window_minima_are_few_and_guaranteed():
    """A run of 20 words that stands in two texts has a minimum selected at the same line of both; most lines are not selected."""
    rng = random.Random(4)
    selected = lines = 0
    for _ in range(300):
        run = [words(rng, rng.randrange(1, 9), 9000) for _ in range(12)]
        while sum(len(x.split()) for x in run) - len(run[-1].split()) >= 20:
            run.pop()
        if sum(len(x.split()) for x in run) < 20:
            continue
        places = []
        for _ in range(2):
            head, tail = ([words(rng, rng.randrange(1, 9), 9000) for _ in range(rng.randrange(1, 25))] for _ in range(2))
            found = {unit for _, unit, *_ in line_dedup.winnow("\n".join(head + run + tail), 20)}
            selected, lines = selected + len(found), lines + len(head + run + tail)
            places.append({u - len(head) for u in found if 0 <= u - len(head) < len(run)})
        assert places[0] & places[1]
    assert 0 < selected < 0.6 * lines


def test_only_live_minima_have_windows(spark):
    """Without the bits of the repeated minima no window goes out, and with them only those around these minima do."""
    rng = random.Random(9)
    shared = [words(rng, 12, 9000) for _ in range(4)]
    texts = [(i, i, "\n".join([words(rng, 9, 9000) for _ in range(20)] + shared * (i < 2))) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text_hash long, text string")
    every = [(i, w[0], w[2]) for i, _, t in texts for w in line_dedup.winnow(t, 30)]
    twice = {m for m, n in collections.Counter({(i, m) for i, m, _ in every}).items() if sum((j, m[1]) in {(k, x) for k, x, _ in every} for j in range(6)) > 1}
    bits = np.zeros(1 << 23, dtype=np.uint8)
    assert line_dedup.positions(docs, bits, 30).count() == 0
    for _, m in twice:
        bits[(m & (1 << 26) - 1) >> 3] |= 1 << (m & 7)
    got = [(r.doc_id, r.fingerprint, r.window) for r in line_dedup.positions(docs, bits, 30).collect()]
    assert sorted(got) == sorted(x for x in every if (x[0], x[1]) in twice) and 0 < len(got) < len(every) / 4


@pytest.mark.parametrize("seed", range(3))
def test_lines_in_changing_company(spark, seed):
    """Lines that many texts share in other surroundings, runs that overlap, repeat in one text and touch its ends."""
    rng = random.Random(seed)
    stock = [words(rng, rng.randrange(1, 12), 9000) for _ in range(14)]
    rows = []
    for i in range(40):
        lines = []
        while len(lines) < 12:
            k = rng.randrange(len(stock))
            lines += stock[k : k + rng.randrange(1, 6)] if rng.random() < 0.7 else [words(rng, 5, 9000), ""]
        rows.append((i, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert {r.doc_id: r.text for r in got} == dict(brute_lines(rows, 20)) and sum(len(r.text) for r in got) < sum(len(t) for _, t in rows)


def test_sentencepieces(docs, none, rows):
    path = vocabulary("piece_bpe_32k.model")
    got = sentencepieces.encode(docs, path, seed=3).collect()
    assert len(got) == len(rows) and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    again = sentencepieces.encode(docs.repartition(5), path, seed=3).collect()
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == sorted((repr(r.doc_id), r.ids_crc32) for r in again)
    assert sentencepieces.encode(docs, path, seed=4).filter("doc_id = 10").first().ids_crc32 != next(r.ids_crc32 for r in got if r.doc_id == 10)
    back = {(r.doc_id, r.text) for r in sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert sentencepieces.encode(none, path).count() == 0


def test_sampling_follows_the_lattice():
    import sentencepiece

    m = sentencepieces.Lattice(vocabulary("piece_bpe_32k.model"))
    ids, at = m.sample(["thenion"] * 20_000, list(range(20_000)), 0)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))

    def ways(s):
        return [[]] if not s else [[p, *r] for e in range(1, len(s) + 1) if (p := s[:e]) in m.pieces for r in ways(s[e:])]

    weight = {tuple(m.pieces[p][0] for p in w): math.prod(m.pieces[p][1] for p in w) for w in ways("▁thenion")}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for k, w in weight.items():
        p = w / total
        assert abs(seen[k] - 20_000 * p) <= 5 * math.sqrt(20_000 * p) + 1
    text = "plain words of a sentence"
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    ids, _ = m.sample([text], [1], 0)
    assert library.decode(ids.tolist()) == text
    long = "thtionoring" * 5
    a = m.sample([long], [5], 7)[0].tolist()
    short, sentencepieces.SHORT = sentencepieces.SHORT, 0
    try:
        assert m.sample([long], [5], 7)[0].tolist() == a
    finally:
        sentencepieces.SHORT = short


def test_a_long_word_in_every_row_is_a_frequent_word(spark, monkeypatch):
    rng = random.Random(2)
    rule = "=" * 3000
    rows = [(i, words(rng, 20, 300) + f"\n{rule}\n" + words(rng, 20, 300)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.xxhash64("doc_id")).withColumn("uid2", F.hash("doc_id")).withColumn("training", F.lit(True))
    found = lm_scoring.frequent_words(d)
    assert lm_scoring.named([rule.encode()])[0] in found and max(map(len, found)) <= lm_scoring.LONG
    got = {r.doc_id: r for r in lm_scoring.score(d.select("doc_id", "text"), F.col("doc_id") % 2 == 0).collect()}
    count = collections.Counter(w for i, t in rows if i % 2 == 0 for w in [*t.split(), "end"])
    n, v = count.total(), len(count)
    for i, t in rows:
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), "end"])
        assert got[i].base_score == pytest.approx(want, rel=1e-9) and got[i].n_known == sum(count[w] > 0 for w in [*t.split(), "end"]) and got[i].train_tokens == n


def test_numbers_that_are_no_letters_have_no_language(spark):
    model = language_id.train(spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(5)] + [(9, "der hund und die katze", "de")], "doc_id long, text string, lang string"))
    texts = ["½ ² ①", "Ⅷ ⅷ", "12 _ 34", "", None, "½ the", "ª", "日本"]
    pred, score = language_id.score_texts(model, texts)
    assert pred[:5] == ["und"] * 5 and score[:5] == [0.0] * 5 and all(p != "und" for p in pred[5:])


def test_languages_are_never_cut(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i}", f"l{i:02}") for i in range(30)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs).languages) == 30
    monkeypatch.setattr(language_id, "LANGUAGES", 29)
    with pytest.raises(ValueError, match="none is left out"):
        language_id.train(docs)


def test_language_scores_are_those_of_naive_bayes(spark):
    """Posteriors against a dictionary of counts: add a half to every bucket, equal priors."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["der", "und", "nicht", "schön"] if i % 2 else ["the", "and", "not", "nice"]) for _ in range(12)), "de" if i % 2 else "en") for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def buckets(text):
        codes = np.array([ord(c) for c in f" {text.lower()} "])
        return [int(g) for x in language_id.grams(codes) for g in x]

    counts = {k: collections.Counter(b for _, t, lang in rows if lang == k for b in buckets(t)) for k in ("de", "en")}
    size = {k: c.total() + 0.5 * language_id.BUCKETS for k, c in counts.items()}
    texts = ["der nice hund", "and", "nicht the", "zzz", "schön und nice and"]
    pred, score = language_id.score_texts(model, texts)
    for t, p, s in zip(texts, pred, score):
        total = {k: sum(math.log((counts[k][b] + 0.5) / size[k]) for b in buckets(t)) for k in counts}
        best = max(sorted(total), key=total.get)
        want = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert s == pytest.approx(want, abs=1e-4) and (p == best or want < 0.5001)


def test_held_out_languages(spark, sf):
    """The registered query on the smallest table: its columns, held-out rows by the remainder, and accuracy on them."""
    from siftstone.llm import queries

    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"} and len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [(r.lang_pred, truth[r.doc_id].lang) for r in got if r.held_out and truth[r.doc_id].lang and len(truth[r.doc_id].text or "") >= 100 and r.lang_pred != "und"]
    assert len(held) > 10 and sum(a == b for a, b in held) >= 0.9 * len(held)


@pytest.mark.parametrize("limits", [(2048, 512, 2048), (512, 6, 150), (256, 3, 40)])
def test_packing_of_conversations(spark, sf, limits):
    """Instruction data: prompts bear no loss, answers and their end do; three limits hold in every sequence."""
    library = __import__("tokenizers").Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.text or ""))
    rows, n = [], 0
    for conv in turns.values():
        said = [x for _, x in sorted(conv)]
        for k in range(0, len(said) - 1, 2):
            rows.append((n, said[k], said[k + 1]))
            n += 1
    rows += [(n, None, "no prompt"), (n + 1, "", ""), (n + 2, "a prompt alone", None), (n + 3, "long prompt " * 900, "long answer " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, ask string, text string")
    got = packing.pack(docs, packing.word_bpe(vocabulary("word_bpe_49k.json")), limits=limits, with_ids=True, prompt="ask").collect()
    sequences, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        by[r.doc_id].append(r)
    for pieces in sequences.values():
        assert sum(r.length for r in pieces) <= limits[0] and len(pieces) <= limits[1] and sum(r.loss_tokens for r in pieces) <= limits[2]
    for i, ask, text in rows:
        lead = library.encode(ask or "", add_special_tokens=False).ids
        body = library.encode(text or "", add_special_tokens=False).ids + [1]
        pieces, at = sorted(by[i], key=lambda r: r.start), 0
        for r in pieces:
            assert r.start == at and r.ids == (lead + body)[at : at + r.length] and r.loss_tokens == max(0, r.start + r.length - max(r.start, len(lead)))
            at += r.length
        assert at == len(lead) + len(body) and sum(r.loss_tokens for r in pieces) == len(body)
    if limits[2] < limits[0]:
        full = [sum(r.loss_tokens for r in pieces) for pieces in sequences.values()]
        assert limits[2] in full and len(sequences) > len(rows) / limits[1]  # the third limit does bind

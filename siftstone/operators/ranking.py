"""Ranked retrieval: inverted-index scoring, exact vector search, fusion, reranking, depth sweeps.

Scores that are sums over groups are rounded before they are ranked, so ranks do not hang on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.session import kept

PLACES = 9
#: Bytes of query vectors, or of query texts, up to which they are broadcast, and vectors of a block.
SMALL, BLOCK = 32 << 20, 2048
#: Bytes of all pairs of blocks that a task hands to Python, where blocks of queries are few enough for that: they may come in one batch.
BATCH = 64 << 20
#: Queries whose whole rankings one task makes at most, scores that it holds for them, and tasks that there are at least.
GROUP, HELD, TASKS = 128, 1 << 26, 32
#: Pairs of a document and a query that a task counts, and partitions for them at most; beyond it Spark's aggregation spills.
PAIRS, MOST = 1 << 20, 4096
#: Terms of queries that a plan names; more are broadcast.
LISTED = 4096


def top(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Rows ranked within `by`; with k only the first k, which Spark cuts before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return top(df, by, order, 1, "__first").drop("__first")


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None, few: bool = False, sizes: bool = True, parts: int | None = None) -> DataFrame:
    """key, length, distinct, term, tf: term frequencies, and the document's numbers of tokens and (with sizes) of distinct ones.

    With terms (a column term) only their postings, and one row of the empty term for each document, which carries its numbers;
    few says that the terms can be broadcast: then tokens that no query has are dropped where they are read.
    parts: into so many partitions by key, so that what a document meets is counted where its postings are.
    A text is tokenised once, before the shuffle. Whoever reads tf, in whatever part of a plan, reads the same shuffle;
    with few it has a row for each text, of terms that are asked for where a plan can name these.
    """
    tokens = docs.select(key, F.concat(tx.search_tokens(F.col(text)), F.array(F.lit(""))).alias("__t"))
    counted = tokens.select(key, "__t", (F.size("__t") - 1).alias("length"), ((F.size(F.array_distinct("__t")) - 1) if sizes else F.lit(0)).alias("distinct"))
    near = parts is not None and few  # no other shuffle comes after
    words = _listed(terms) if near else None
    if near:  # a row for each text: a task holds all that it writes to many partitions, and a row for each token takes several times as much
        asked = F.col("__t") if words is None else F.filter("__t", lambda x: (x == "") | x.isin(words))
        counted = counted.withColumn("__t", asked).repartition(parts, key)
    numbered = counted.select(key, "length", "distinct", (F.explode_outer if terms is None else F.explode)("__t").alias("term"))
    if terms is not None and words is None:
        wanted = terms.select("term").distinct().union(terms.sparkSession.range(1).select(F.lit("").alias("term")))
        numbered = numbered.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    if parts is not None and not near:
        numbered = numbered.repartition(parts, key)
    return numbered.groupBy(key, "length", "distinct", "term").agg(F.count("*").alias("tf"))


def _real(tf: str = "tf") -> Column:
    """1 for postings, 0 for the rows of the empty term: said so that no filter comes between readers of one shuffle."""
    return F.when((F.col("term") != "") & (F.col(tf) > 0), 1).otherwise(0)


def query_terms(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    return queries.select(query_key, F.explode(F.array_distinct(tx.search_tokens(F.col(query_text)))).alias("term"))


def _listed(terms: DataFrame) -> list[str] | None:
    """The terms in order, where they are at most LISTED; they are then written into the plan."""
    found = [r["term"] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    return sorted(found) if len(found) <= LISTED else None


def _few(queries: DataFrame, query_text: str) -> bool:
    """Whether the texts of the queries, and so their terms, are at most SMALL bytes."""
    return (queries.agg(F.sum(F.octet_length(query_text).cast("long")).alias("n")).collect()[0]["n"] or 0) <= SMALL


def _parts(docs: DataFrame, queries: DataFrame) -> int:
    """Partitions of postings, so that in each at most about PAIRS documents meet queries."""
    return min(MOST, max(TASKS, -(-docs.count() * queries.count() // PAIRS)))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "query", depth: int | None = 50, sizes: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank. Terms of a query count once; documents without any of them are left out.

    sizes: reads postings as overlaps() does, for plans that have both.

    Texts are tokenised in one scan; document frequencies, the number of documents and their mean length come from the same postings.
    """
    terms = query_terms(queries, query_key, query_text)
    few = _few(queries, query_text)
    small = F.broadcast if few else (lambda x: x)  # no more terms than the queries have
    index = postings(docs, key, text, terms, few, sizes, _parts(docs, queries))
    sizes = index.agg(F.sum(F.when(F.col("tf") > 0, 1 - _real())).alias("n_docs"), F.sum(F.when(F.col("tf") > 0, F.col("length") * (1 - _real()))).alias("total"))
    spread = index.groupBy("term").agg(F.sum(_real()).alias("df"))
    weighted = index.join(small(spread), "term").crossJoin(F.broadcast(sizes))  # one row
    mean = F.when(F.col("total") > 0, F.col("total") / F.col("n_docs")).otherwise(1.0)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("length") / mean))
    scored = weighted.withColumn("part", part).join(small(terms), "term").groupBy(query_key, key).agg(F.round(F.sum("part"), PLACES).alias("score"))
    return top(scored.filter("score > 0"), [query_key], [F.desc("score"), F.asc(key)], depth)


def overlaps(docs: DataFrame, queries: DataFrame, least: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, doc_id, size, overlap: distinct terms of a document, and how many of them a query has, at least `least`."""
    terms = query_terms(queries, query_key, query_text)
    few = _few(queries, query_text)
    met = postings(docs, key, text, terms, few, parts=_parts(docs, queries)).join(F.broadcast(terms) if few else terms, "term")
    return met.groupBy(query_key, key, F.col("distinct").alias("size")).agg(F.sum(_real()).alias("overlap")).filter(F.col("overlap") >= least)


_BLOCK = "ids binary, vectors binary"


def _width(rows: DataFrame, vector: str) -> str:
    return "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"


def _blocks(rows: DataFrame, key: str, vector: str, size: int, partial: bool = False) -> DataFrame:
    """The rows as matrices of `size` rows at most: ids and vectors as bytes, float vectors as such, others as doubles. partial: rows without a vector are left out.

    They are left out here, for a filter would make each vector twice where it is an expression.
    """
    import numpy as np
    import pyarrow as pa

    kind = _width(rows, vector)

    def work(batches):
        for b in batches:
            b = b.filter(b.column(1).is_valid()) if partial else b
            for at in range(0, b.num_rows, size):
                ids, vectors = b.column(0)[at : at + size], b.column(1)[at : at + size]
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes()]), pa.array([vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()])], names=["ids", "vectors"])

    return rows.select(F.col(key).cast("long"), F.col(vector) if kind == "<f4" else vec.doubles(F.col(vector))).mapInArrow(work, _BLOCK)


def _meet(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, groups: int | None = None, partial: bool = False) -> DataFrame:
    """Pairs of blocks of both sides; the queries' are broadcast up to SMALL bytes, beyond that blocks meet blocks without a broadcast.

    The corpus is dealt over as many tasks as hold BATCH bytes of pairs each. With groups the queries are dealt over so many partitions, and each of them meets all blocks of the
    corpus where it lies: these are made once, and read from the shared folder by every group, so that no vector is shuffled for a group.
    """
    asked = _blocks(queries if groups is None else queries.repartition(groups), query_key, query_vector, BLOCK)
    asked = asked.select(F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    told = _blocks(corpus, key, vector, BLOCK, partial)
    if groups is not None:
        return _kinds(kept(told).coalesce(1).hint("shuffle_replicate_nl").crossJoin(asked), corpus, vector, queries, query_vector)
    small = queries.select(F.sum(8 * F.size(F.col(query_vector)).cast("long") + 8).alias("n")).collect()[0]["n"] or 0
    if small:
        told = told.repartition(max(TASKS, -(-corpus.count() // BLOCK) // max(1, BATCH // (2 * small))))  # a block meets all queries: about twice their bytes
    return _kinds(told.crossJoin(F.broadcast(asked) if small <= SMALL else asked), corpus, vector, queries, query_vector)


def _kinds(pairs: DataFrame, corpus: DataFrame, vector: str, queries: DataFrame, query_vector: str) -> DataFrame:
    return pairs.select("ids", "vectors", "qids", "qvectors", F.lit(_width(corpus, vector)).alias("kind"), F.lit(_width(queries, query_vector)).alias("qkind"))


def _scored(batches, measure: str):
    """(ids, query ids, scores by query) of each pair of blocks."""
    import numpy as np

    for b in batches:
        for row in range(b.num_rows):  # one pair of blocks in memory at a time
            ids, vectors, qids, qvectors, kind, qkind = (b.column(c)[row].as_py() for c in ("ids", "vectors", "qids", "qvectors", "kind", "qkind"))
            i, q = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
            m, u = (np.frombuffer(x, k).astype("<f8", copy=False).reshape(len(n), -1) for x, k, n in ((vectors, kind, i), (qvectors, qkind, q)))
            if measure == "cosine":
                score = (u / np.sqrt((u * u).sum(axis=1, keepdims=True))) @ m.T
            else:
                t = np.ascontiguousarray(m.T)  # sums over the first axis go component by component, as SQL's do
                score = np.stack([((t - x[:, None]) ** 2).sum(axis=0) for x in u])
            score *= 10**PLACES
            whole = np.trunc(score)
            yield i, q, (whole + np.copysign(np.abs(score - whole) >= 0.5, score)) / 10**PLACES + 0.0  # halves go away from zero, as in SQL


def whole_rankings(corpus: DataFrame, queries: DataFrame, measure: str = "cosine", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """query_id, vec_id, score, rank of every vector for every query, as knn() has them.

    Rows are as many as pairs, so they grow with the square of the table; none of them is shuffled. Vectors are not either: a task of up to GROUP queries
    reads all of them, holds its scores, about HELD at most, and ranks them.
    """
    import numpy as np
    import pyarrow as pa

    def work(batches):
        met = {}
        for i, q, score in _scored(batches, measure):
            if 0 <= score.min() and score.max() * 10**PLACES < 1 << 32:  # whole numbers of the last place: half the memory, nothing lost
                score = np.rint(score * 10**PLACES).astype("<u4")
            met.setdefault(q.tobytes(), []).append((i, score))
        for qids, blocks in met.items():
            ids = np.concatenate([i for i, _ in blocks])
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            for at, x in enumerate(np.frombuffer(qids, "<i8")):
                row = np.concatenate([s[at] / 10**PLACES if s.dtype.kind == "u" else s[at] for _, s in blocks])[by_id]
                best = np.argsort(row if measure == "l2" else np.where(np.isnan(row), -np.inf, -row), kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), x)), pa.array(ids[best]), pa.array(row[best]), pa.array(np.arange(1, len(best) + 1, dtype="<i4"))], names=["query_id", "vec_id", "score", "rank"])

    n, asked = corpus.count(), queries.count()
    pairs = _meet(corpus, queries, key, vector, query_key, query_vector, max(1, -(-asked // max(1, min(GROUP, HELD // max(1, n)))), min(TASKS, asked)))
    return pairs.mapInArrow(work, "query_id long, vec_id long, score double, rank int").select(F.col("query_id").alias(query_key), F.col("vec_id").alias(key), "score", "rank")


def knn(corpus: DataFrame, queries: DataFrame, k: int | None, measure: str = "cosine", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query", within: float | None = None, partial: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: exact search of every query against every vector; scores have PLACES places, ties go by id.

    cosine: dot product with the re-normalised query, larger first; l2: squared distance, smaller first. Each pair of blocks is one matrix
    product that keeps the k best of a block for each query; within drops scores beyond a gate there (below it for cosine, above it for l2).
    With neither, whole_rankings() ranks the pairs where they are made. partial: rows of the corpus may lack a vector, and are not found.
    """
    if k is None and within is None:
        corpus = corpus.filter(F.col(vector).isNotNull()) if partial else corpus
        return whole_rankings(corpus, queries, measure, key, vector, query_key, query_vector)
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for i, q, score in _scored(batches, measure):
            parts = []
            for x, row in zip(q, score, strict=True):
                if within is not None:
                    at = np.flatnonzero(row >= within if measure == "cosine" else row <= within)
                else:
                    at = np.arange(len(row))
                best = at[np.lexsort((i[at], -row[at] if measure == "cosine" else row[at]))[:k]]
                parts.append((np.full(len(best), x), i[best], row[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = _meet(corpus, queries, key, vector, query_key, query_vector, partial=partial)
    scored = pairs.mapInArrow(work, "query_id long, vec_id long, score double").select(F.col("query_id").alias(query_key), F.col("vec_id").alias(key), "score")
    order = F.desc("score") if measure == "cosine" else F.asc("score")
    return top(scored, [query_key], [order, F.asc(key)], k)


def best_products(corpus: DataFrame, queries: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """by (query_key or key), pairs, best: how many of the other side each row met, and its greatest cosine; one row a block leaves a task, never one a pair."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for i, q, score in _scored(batches, "cosine"):
            ids, axis = (q, 1) if by == query_key else (i, 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), score.shape[axis])), pa.array(score.max(axis=axis))], names=["id", "pairs", "best"])

    found = _meet(corpus, queries, key, vector, query_key, query_vector).mapInArrow(work, "id long, pairs long, best double")
    return found.groupBy(F.col("id").alias(by)).agg(F.sum("pairs").alias("pairs"), F.max("best").alias("best"))


def rrf(rankings: DataFrame, by: list[str], item: str, k: int = 60) -> DataFrame:
    """by, item, rrf, origins, fusion_rank of rankings (.., channel, rank): sums of 1 / (k + rank), added in order of (channel, rank)."""
    origins = F.array_sort(F.collect_list(F.struct("channel", "rank")))
    fused = rankings.groupBy(*by, item).agg(origins.alias("origins"))
    total = F.aggregate("origins", F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / (k + x["rank"]))
    return top(fused.withColumn("rrf", F.round(total, 12)), by, [F.desc("rrf"), F.asc(item)], None, "fusion_rank")


def fusion_faults(rankings: DataFrame, by: list[str], item: str) -> DataFrame:
    """Items that one list names twice, and scores that are not finite."""
    twice = rankings.groupBy(*by, "channel", item).count().filter("count > 1").select(*by, "channel", item, F.lit("duplicate").alias("fault"))
    if "score" not in rankings.columns:
        return twice
    odd = rankings.filter(F.isnan("score") | (F.abs("score") == float("inf"))).select(*by, "channel", item, F.lit("not_finite").alias("fault"))
    return twice.unionByName(odd)


def strongest_query(origins: DataFrame, by: list[str], query: str, k: int = 60) -> DataFrame:
    """For each `by`: the query with the largest sum of 1 / (k + rank); a tie goes to the greatest query."""
    sums = origins.groupBy(*by, query).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("strength"))
    return sums.groupBy(*by).agg(F.max_by(query, F.struct("strength", query)).alias(query), F.max("strength").alias("strength"))


def depth_sweep(ranked: DataFrame, by: list[str], depths: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """One ranking read at several depths: by, depth and the rows within it."""
    return ranked.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).filter(F.col("rank") <= F.col("depth"))


def lexical_score(title: Column, body: Column, history: Column) -> Column:
    return 3 * title + 2 * body + history


def role_ranking(logit: Column, matched: Column, observed: Column, cosine: Column, fused: Column, demographic: Column) -> Column:
    """The blended ranking value of a role; coverage is matched over observed concepts."""
    return logit + 0.5 * matched / F.greatest(F.lit(1), observed) + 0.1 * cosine + 0.1 * fused + 0.2 * demographic

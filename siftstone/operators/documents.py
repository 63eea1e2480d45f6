"""Documents to chunks: section merging, word windows, first-wins dedupe, upserts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import ids
from siftstone.functions import text as tx
from siftstone.operators.constraints import assert_valid, violations
from siftstone.operators.ranking import first_of
from siftstone.session import kept

VERSION = "words-v1:180:30"


def merge_sections(sections: Column, least: int = 40, most: int = 180) -> Column:
    """Folds short neighbours of an array of (title, text): joined where the shorter has under `least` words and both have at most `most`."""
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    item = "array<struct<title:string,text:string>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        a, b = words(last["text"]), words(x["text"])
        joined = F.struct(F.concat_ws(" / ", F.when(last["title"] != "", last["title"]), F.when(x["title"] != "", x["title"])).alias("title"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))
        fits = (F.size(acc) > 0) & (F.least(a, b) < least) & (a + b <= most)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(item)

    tidy = F.transform(sections, lambda s: F.struct(s["title"].alias("title"), tx.clean(F.concat_ws(" ", s["title"], s["text"])).alias("text")))
    return F.aggregate(tidy, F.array().cast(item), step)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 180, stride: int = 150) -> DataFrame:
    """key, chunk_index, text, chunk_id: windows of each document; a window whose text the document already gave is left out.

    All within the document's row: no shuffle.
    """
    once = F.array_distinct(F.transform(tx.windows(F.col(text), size, stride), lambda w: w["text"]))
    out = docs.select(key, F.posexplode(once).alias("chunk_index", "text"))
    name = F.concat_ws("/", F.lit("medical-knowledge"), F.col(key).cast("string"), F.lit(VERSION), F.col("chunk_index").cast("string"), ids.digest(F.col("text")))
    return out.select(key, "chunk_index", "text", ids.uuid5(name).alias("chunk_id"))


#: Rows that say which words are frequent, and counters for them; they have an effect on speed alone. Rows of a batch that are worked on at a time.
SAMPLED, COUNTERS, PIECE = 20_000, 1 << 20, 256
#: Pairs of sets that a task looks at at a time, where no set alone meets more.
PAIRS = 1 << 18
#: Members up to which a set has the least parity, of 4 longs; twice as many have twice as many longs, of which MARKS at most go to where sets meet.
FEW, MARKS = 384, 16


def _marked(named: DataFrame, percent: int, often) -> DataFrame:
    """k, g, same, n, begun, near, parity of rows (k, g, same, h), h the hashes of a set's members.

    begun: those hashes by which similar sets meet, the rarest first; near, parity: bits that are each the parity of how many members fall on them,
    so two sets differ in at least as many members as in bits. parity grows with the set; near is it folded to MARKS longs at most.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    def lists(values, sizes):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")), pa.array(values))

    def folded(bits, hashes, row, longs):
        at = hashes & (64 * longs[row] - 1)
        np.bitwise_xor.at(bits, (np.cumsum(longs) - longs)[row] + (at >> 6), np.left_shift(np.int64(1), at & 63))
        return lists(bits, longs)

    def work(batches):
        for b in (batch.slice(at, PIECE) for batch in batches for at in range(0, batch.num_rows, PIECE)):
            b = b.filter(pc.greater(pc.list_value_length(b.column(3)), 0))  # in SQL the filter would make a set twice
            h = b.column(3).flatten().to_numpy()
            n = b.column(3).value_lengths().to_numpy().astype("<i8")
            row = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, often[h & (COUNTERS - 1)], row))]
            begun = n + (-percent * n) // 100 + 1
            first = np.arange(len(h)) - (np.cumsum(n) - n)[row] < begun[row]
            longs = 4 << np.ceil(np.log2(np.maximum(n / FEW, 1))).astype("<i8")
            near = np.minimum(longs, MARKS)
            parities = [folded(np.zeros(s.sum(), "<i8"), h >> 20, row, s) for s in (near, longs)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n.astype("<i4")), lists(h[first], begun), *parities], names=["k", "g", "same", "n", "begun", "near", "parity"])

    schema = StructType(named.schema.fields[:3]).add("n", IntegerType()).add("begun", ArrayType(LongType())).add("near", ArrayType(LongType())).add("parity", ArrayType(LongType()))
    return named.mapInArrow(work, schema)


def _frequent(named: DataFrame, rows: int):
    """How often hashes fall on each of COUNTERS counters in about SAMPLED of the rows."""
    import numpy as np

    some = named.filter(F.pmod(F.xxhash64("k"), F.lit(max(1, rows // SAMPLED))) == 0)
    counted = some.select(F.explode_outer("h").alias("h")).filter("h is not null").groupBy(F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count("*").alias("n")).toArrow()
    often = np.zeros(COUNTERS, "<i4")
    often[counted["at"].to_numpy()] = counted["n"].to_numpy()
    return often


def _met(first: DataFrame, percent: int) -> DataFrame:
    """a, b of rows (k, n, near, at, word) that meet in a word, where sizes, what is left of both and bits allow the overlap; at most PAIRS pairs are looked at at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import StructField, StructType

    def pairs(t):
        n, place, word = (t[c].to_numpy().astype("<i8") for c in ("n", "at", "word"))
        left, k = n - place, t["k"].combine_chunks()
        longs, bits, marks = t["near"].combine_chunks().value_lengths().to_numpy(), t["near"].combine_chunks().flatten().to_numpy().view("<u8"), {}
        for size in (4, 8, MARKS):
            marks[size] = np.zeros((len(n), size), "<u8")
            for own in (s for s in (4, 8, MARKS) if s >= size):
                marks[size][longs == own] = np.bitwise_xor.reduce(bits[np.repeat(longs == own, longs)].reshape(-1, own // size, size), axis=1)
        group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) << 32
        many = np.searchsorted(group + n, group + n * 100 // percent, "right") - np.arange(len(n)) - 1  # rows go by size in a word
        done = np.cumsum(many)
        start = 0
        while start < len(n):
            before = done[start] - many[start]
            end = max(start + 1, int(np.searchsorted(done, before + PAIRS, "right")))
            i = np.repeat(np.arange(start, end), many[start:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[start:end] - many[start:end] - before, many[start:end])
            start = end
            may = (100 + percent) * np.minimum(left[i], left[j]) >= percent * (n[i] + n[j])
            i, j = i[may], j[may]
            apart = np.zeros(len(i), "<i8")
            for size, of in marks.items():
                rows = np.minimum(longs[i], longs[j]) == size
                apart[rows] = np.bitwise_count(of[i[rows]] ^ of[j[rows]]).sum(axis=1)
            may = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
            a, b = k.take(pa.array(i[may])), k.take(pa.array(j[may]))
            yield pa.RecordBatch.from_arrays([pc.if_else(pc.less(a, b), a, b), pc.if_else(pc.less(a, b), b, a)], names=["a", "b"]).filter(pc.not_equal(a, b))

    def work(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            word = held["word"].to_numpy()
            last = int(np.searchsorted(word, word[-1])) if len(word) else 0  # the last word may go on in the next batch
            if last:
                yield from pairs(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from pairs(held)

    key = first.schema["k"].dataType
    return first.repartition("word").sortWithinPartitions("word", "n").mapInArrow(work, StructType([StructField("a", key), StructField("b", key)]))


def similar_pairs(rows: DataFrame, key: str, group: str, words: str, percent: int) -> DataFrame:
    """a, b, jaccard, copies_a, copies_b: pairs of different word sets (arrays without repeats) of one group with a Jaccard of percent or more.

    Rows of equal sets go as one, by the least key, with their number. Two such sets share one of the rarest words of each: of n
    words, n less the least overlap and one more. Sets that meet in such a word go on where their sizes, what is left of both from their first common word on,
    and the parities of their members allow the overlap: bounds that no similar pair breaks. Hashes stand for words up to there, and are read once into the shared folder;
    whole sets are made again for the pairs that are left, and joined to them alone.
    """
    w = F.col("w")
    sets = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(words).alias("w"))
    same = F.unhex(F.sha2(F.to_json(F.struct("g", F.array_sort(w).alias("w"))), 256)).alias("same")
    named = sets.select("k", "g", same, F.transform(w, lambda x: F.xxhash64("g", x)).alias("h"))  # words that share a hash meet for nothing
    marked = _marked(named, percent, _frequent(named, rows.count()))
    whole = kept(marked.groupBy("g", "same", "n", "begun", "near", "parity").agg(F.min("k").alias("k"), F.count("*").alias("copies")))
    met = _met(whole.select("k", "n", "near", F.posexplode("begun").alias("at", "word")), percent).distinct()
    side = lambda x: whole.select(F.col("k").alias(x), F.struct("g", "same", "n", "copies", "parity").alias(f"of_{x}"))
    sizes = [F.size(f"of_{x}.parity") for x in "ab"]
    longs, unlike = F.least(*sizes), F.greatest(*sizes) > 2 * F.least(*sizes)
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: F.when(F.size(x) > longs, F.zip_with(F.slice(x, F.lit(1), longs), F.slice(x, longs + 1, longs), xor)).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(half("of_a.parity"), half("of_b.parity"), xor), F.lit(0), lambda acc, x: acc + F.bit_count(x))
    agreed = met.join(side("a"), "a").join(side("b"), "b").filter((F.col("of_a.g") == F.col("of_b.g")) & ((longs <= MARKS) | unlike | ((100 + percent) * apart <= (100 - percent) * (F.col("of_a.n") + F.col("of_b.n")))))
    agreed = kept(agreed.select("a", "b", F.col("of_a.same").alias("same_a"), F.col("of_b.same").alias("same_b"), F.col("of_a.copies").alias("copies_a"), F.col("of_b.copies").alias("copies_b")))

    asked = sets.join(agreed.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k", "left_semi").select("k", same, "w").dropDuplicates(["k", "same"])
    left, right = (asked.select(F.col("k").alias(x), F.col("same").alias(f"same_{x}"), w.alias(f"w{x}")) for x in "ab")
    j = tx.jaccard(F.col("wa"), F.col("wb"))
    told = agreed.join(left, ["a", "same_a"]).join(right, ["b", "same_b"]).filter(j >= percent / 100)
    return told.select("a", "b", F.round(j, 9).alias("jaccard"), "copies_a", "copies_b")


def first_wins(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text in a total order."""
    return first_of(rows, [text], [F.asc(c) for c in order])


def lost(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Keys of which no row was kept."""
    return rows.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """stored with the batch's rows in place of its own; within the batch the last row of a key wins."""
    last = first_of(batch, [key], [F.desc(order)]).drop(order)
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def upsert_valid(stored: DataFrame, batch: DataFrame, key: str, order: str, rules: dict[str, Column], vector: str, size: int) -> tuple[DataFrame, int]:
    """upsert() of a batch that is whole, and the number of its different keys.

    Every row of the batch is looked at first, those that a later row of their key will replace too: the rules hold, and the vector has size finite components of which
    one is not 0. One bad row refuses the batch, and nothing of it is taken. Only the first faults come to the driver, and a count.
    """
    v = F.col(vector)
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    assert_valid(violations(batch, {**rules, "key": F.col(key).isNotNull(), "vector": sound}, [key]), "upsert")
    return upsert(stored, batch, key, order), batch.select(key).distinct().count()


def counts_by(docs: DataFrame, domain: DataFrame, by: str) -> DataFrame:
    """by, n for every value of the domain, zeros included."""
    return domain.select(by).join(docs.groupBy(by).agg(F.count("*").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))

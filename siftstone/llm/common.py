"""What the operators share: reading tables, the shared scratch folder, Arrow map functions."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import ship

#: The words of the contracts: runs of anything but these six ASCII characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="siftstone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df to the shared folder once and returns it as read from there: lineage ends and a lost executor costs nothing.

    small: what many tasks give a few rows each of is first brought together to files of a fair size, as many as it takes.
    The files stay until discard() or until the folder is removed; the caller's result may still read them lazily.
    """
    df = df.hint("rebalance") if small else df
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no plan still to be run reads."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the bitmaps that pick out rows in a scan: 8 MB, whatever the corpus. A full one picks out everything.
BITS = 26


def bits_of(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bit of each value of a long column set."""
    marks = df.select((F.pmod(F.col(column), F.lit(1 << BITS)) + 1).alias("bit"))  # the bitmap functions count from 1
    rows = marks.groupBy(F.expr("bitmap_bucket_number(bit)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    out, per = np.zeros(1 << (BITS - 3), dtype=np.uint8), 4096
    for r in rows:
        out[(r["k"] - 1) * per : r["k"] * per] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def has_bit(bits: np.ndarray, value: int) -> bool:
    bit = value & (1 << BITS) - 1
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: Python objects of one slice are alive at a time. What a task leaves free goes back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def give_back() -> None:
    """Free memory of this process to the system: workers live on from task to task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string, arrays of plain types included; works in workers, where no session is."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(name, kind(of)) for name, of in (part.split() for part in ddl.split(","))])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def crc_of_id(doc_id) -> int:
    """crc32 of the id as decimal text; of a null id, of the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def row_sample(docs: DataFrame, at_most: int, key: str = "doc_id") -> DataFrame:
    """About at_most rows, chosen by a hash of the key: the same rows on every run."""
    n = docs.count()
    if n <= at_most:
        return docs
    share = int(at_most / n * 1_000_000) + 1
    return docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < share)

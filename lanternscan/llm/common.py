"""Helpers that the operators of this subpackage share.

Texts travel to Python as Arrow binary, so that words can be split on ASCII
bytes: ``bytes.split()`` splits exactly at ``[\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}

#: An odd multiplier of the rolling polynomial hash (modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)

#: Bytes of letters and digits stay, A-Z become a-z, other ASCII becomes a space.
ITEM_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def item_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return data.translate(ITEM_BYTES).split()


def token_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each window of k consecutive token hashes, in order."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = tokens[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += tokens[j : j + n]
    out ^= out >> np.uint64(31)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words some window [start, start + length) covers."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: Rows that are turned into Python objects at a time; an Arrow batch may hold twenty times as many, and long texts.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def map_documents(
    docs: DataFrame,
    columns: Iterable,
    schema: str,
    build: Callable[[], Callable[..., Iterator[list] | list]],
) -> DataFrame:
    """Run Arrow batches of ``columns`` through a function that ``build()`` makes once a task.

    The function gets one list per column and returns (or yields) lists per output column.
    """
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = build()
        for batch in slices(batches):
            got = fn(*[c.to_pylist() for c in batch.columns])
            for cols in [got] if isinstance(got, (list, tuple)) else got:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(cols, arrow)],
                    schema=arrow,
                )

    return docs.select(*columns).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, build: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose text the function that ``build()`` makes keeps."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = build()
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.column(at).cast(pa.binary()).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_bytes(name: str = "text"):
    return F.col(name).cast("binary").alias("data")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a membership filter: a fixed 4 MB, whatever the input.
FILTER_BITS = 1 << 24


def _bitmap(wanted: DataFrame, column: str) -> tuple[DataFrame, Callable, Callable]:
    """The filter as a table of words, and the expressions for a value's word and bit."""
    place = lambda c: f"pmod(xxhash64(`{c}`), {FILTER_BITS}L)"
    bit = lambda c: F.expr(f"shiftleft(1L, cast({place(c)} % 64 AS INT))")
    word = lambda c: F.expr(f"{place(c)} div 64")
    return wanted.groupBy(word(column).alias("_word")).agg(F.bit_or(bit(column)).alias("_bits")), word, bit


def only_likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long column may be among ``wanted(column)``; a join behind it shuffles less.

    The filter is a hashed bitmap of a fixed size, which is what makes it safe to broadcast. False hits only cost work.
    """
    bits, word, bit = _bitmap(wanted, column)
    kept = df.join(F.broadcast(bits), word(column) == F.col("_word"))
    return kept.filter(F.col("_bits").bitwiseAND(bit(column)) != 0).drop("_word", "_bits")


def split_likely(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that ``only_likely`` keeps, and the others."""
    bits, word, bit = _bitmap(wanted, column)
    flagged = df.join(F.broadcast(bits), word(column) == F.col("_word"), "left")
    flagged = flagged.withColumn("_likely", F.coalesce(F.col("_bits").bitwiseAND(bit(column)) != 0, F.lit(False))).drop("_word", "_bits")
    return flagged.filter("_likely").drop("_likely"), flagged.filter("NOT _likely").drop("_likely")


#: Rows of a table that may be sent to every task.
FEW = 50_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """A narrow table for a join: broadcast when it has at most ``FEW`` rows, which are counted; else as it is, for a shuffle."""
    rows = df.limit(FEW + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= FEW else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; the warehouse where none is named, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


#: Shuffle files of a finished SQL execution go at once, instead of when the driver's garbage collection finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a Parquet table and read it again; the shuffle files that led to it are removed, as nothing needs them any more."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one job, by name, in the shared folder: they cut lineage, survive lost executors, and go when they are dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", set()

    def store(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        return write_table(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            remove(self.spark, f"{self.folder}/{name}")

    def keep(self, *names: str) -> None:
        """Drop all other tables."""
        self.drop(*(self.names - set(names)))

"""Files, text tables and side inputs as DataFrames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternscan.functions.text import excluded_path
from lanternscan.schema import FINDING

DEFAULT_MB = 10


def size_limit(megabytes: int) -> int:
    """Bytes; 0 or less means the default, not unlimited."""
    return (megabytes if megabytes > 0 else DEFAULT_MB) * 1024 * 1024


def relative_to(root: str, path: Column) -> Column:
    """The path below the root, without scheme."""
    plain = F.regexp_replace(path, r"^[a-z]+:(?://[^/]*)?(?=/)", "")
    return F.regexp_replace(plain, "^" + r"\Q" + root.rstrip("/") + r"\E" + "/?", "")


def read_files(spark: SparkSession, root: str, max_mb: int = 0, exclude: Sequence[str] = (), commit: str = "") -> DataFrame:
    """path (relative), content, length, commit of all files below a folder, version control data and excluded paths left out.

    The size filter reaches the scan; contents of files that are too large are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(F.col("length") <= size_limit(max_mb)).withColumn("path", relative_to(root, F.col("path")))
    inner = ~F.col("path").rlike(r"(?:^|/)\.git/") & ~excluded_path("path", exclude)
    return files.filter(inner).select("path", "content", "length", F.lit(commit).alias("commit"))


def from_table(df: DataFrame, text: str, path: Column | str) -> DataFrame:
    """Rows of any table as contents: path, content."""
    return df.select((F.col(path) if isinstance(path, str) else path).alias("path"), F.col(text).cast("binary").alias("content"))


def read_lines(spark: SparkSession, path: str, name: str, windows: int = 0) -> DataFrame:
    """A text file as numbered lines under a fixed name, as a pipe would give them. Tasks read ranges of whole lines."""
    from lanternscan.operators.lines import split_lines
    from lanternscan.sources.blocks import BLOCK_WINDOWS, BlockSource

    spark.dataSource.register(BlockSource)
    reader = spark.read.format("file_blocks").option("lines", "true").option("windows", windows or BLOCK_WINDOWS)
    blocks = reader.load(qualified(spark, path)).select("block", F.col("data").cast("string").alias("text"))
    # one row of numbers per block of some megabytes
    breaks = blocks.select("block", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = breaks.select(F.col("block").alias("nth"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("first"))
    lines = split_lines(blocks.join(F.broadcast(first), F.col("block") == F.col("nth")).select(F.lit(name).alias("path"), "first", "text"))
    return lines.withColumn("line_no", F.col("line_no") + F.col("first")).drop("first")


#: Bytes of a pipe that the driver holds at a time.
PIPE_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where none is named."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, for tasks that do not know the cluster's default file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def read_pipe(spark: SparkSession, stream: BinaryIO, name: str, block_bytes: int = PIPE_BYTES) -> DataFrame:
    """The lines of a byte stream, numbered, under a fixed name. Blocks of whole lines are stored as they come, and scanned by the tasks."""
    from lanternscan.operators.lines import split_lines

    at, first = f"{shared_folder(spark)}/pipe-{uuid.uuid4().hex}", 0
    schema = "path string, first int, text string"
    spark.createDataFrame([], schema).write.parquet(at)
    while block := stream.readlines(block_bytes):
        rows = [(name, first, b"".join(block).decode("utf-8", "replace"))]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(at)
        first += len(block)
    lines = split_lines(spark.read.schema(schema).parquet(at))
    return lines.withColumn("line_no", F.col("line_no") + F.col("first")).drop("first")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier report (a JSON array)."""
    return spark.read.schema(FINDING).json(path, multiLine=True)


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints, one a line; blank lines and comments are left out."""
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("fingerprint")).filter((F.col("fingerprint") != "") & ~F.col("fingerprint").startswith("#"))


def linked_paths(root: str) -> list[tuple[str, str]]:
    """(relative path, real path) of all files below a local folder, links inside it followed, each folder once."""
    top = os.path.realpath(root)
    seen: set[str] = set()
    out = []
    for folder, dirs, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen or os.path.commonpath([top, real]) != top:
            dirs.clear()
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if d != ".git")
        for name in sorted(names):
            target = os.path.realpath(os.path.join(folder, name))
            if os.path.isfile(target) and os.path.commonpath([top, target]) == top:
                out.append((os.path.relpath(os.path.join(folder, name), root), target))
    return out


def read_linked_files(spark: SparkSession, root: str, max_mb: int = 0, exclude: Sequence[str] = (), commit: str = "") -> DataFrame:
    """read_files() for a local or mounted folder with symbolic links followed; only paths are listed on the driver."""
    limit = size_limit(max_mb)
    paths = spark.createDataFrame(linked_paths(root), "path string, real string").filter(~excluded_path("path", exclude))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, real in zip(*[c.to_pylist() for c in batch.columns]):
                if os.path.getsize(real) <= limit:
                    with open(real, "rb") as f:
                        data = f.read()
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], type=pa.binary()), pa.array([len(data)])], names=["path", "content", "length"])

    tasks = max(1, min(1000, 4 * spark.sparkContext.defaultParallelism))
    return paths.repartition(tasks).mapInArrow(run, "path string, content binary, length long").withColumn("commit", F.lit(commit))

"""Token ids as Arrow files of equal-length sequences, for random access without copies.

Documents are sorted by their id over range partitions, encoded, and each partition becomes one pair of Arrow files (a stream of
batches closed by a footer): ``*.ids.arrow`` has the ids, end to end, cut into sequences of a fixed length, with a mask of one bit
per place that is 0 only for the padding behind a file's last id; ``*.docs.arrow`` says where in the file each document starts
and how long it is. Both columns of the first are fixed-size lists and all batches but the last have the same number of rows,
so sequence k is row k % rows of batch k // rows: a memory-mapped file gives views of its ids and mask bytes. Ids take two bytes
where the vocabulary allows it.

A task writes under a name of its own attempt and returns the name; what the stored manifest does not list (tasks that were
lost or repeated) is removed. Files go to a folder that all executors reach, by any scheme that Arrow's file systems know.

Handling: a null text is an empty one, its only id is the end id. A null doc_id comes before all others; rows that repeat a doc_id
are separate documents, in the order of a hash of their texts. Texts are encoded whole; very long ones word by word. An empty
table gives files of no rows, or none. Further columns of the documents are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_folder, slices, table

SEQUENCE = 2048
END_ID = 2
#: Sequences in a batch.
BATCH_ROWS = 256
#: Chunks and words whose ids a worker remembers (about 150 bytes each), and the longest that are.
CACHE_CHUNKS, CACHE_WORDS, CACHE_BYTES = 1_500_000, 1_000_000, 64
#: A chunk beyond this is encoded pretoken by pretoken, as the library's record of a token is many times as large as its text.
LONG_CHUNK = 1 << 20
MANIFEST = "part int, ids_path string, docs_path string, n_ids long, n_docs long, n_sequences long"

# Fixed value: the pattern that splits a text before the merges of this vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space and the word behind it. No token reaches from a word into the white space behind, so chunks are encoded one by one.
CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: White space beyond ASCII, which may continue such a run.
OTHER_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: A chunk of one Latin word, which is a pretoken with the space before it, and marks, which are another.
PLAIN = re.compile("(?:\n|( ))?([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
#: Letters that stand for bytes in the vocabulary: printable bytes for themselves, the others from 256 on.
BYTE_LETTERS = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTE_LETTERS |= {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in BYTE_LETTERS)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder(dict):
    """Ids of a text as little-endian bytes of ``dtype``, remembered by chunk."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pretoken = regex.compile(PRETOKEN)
        self.model, self.words = self.tokenizer.model, {}

    def word(self, word: str) -> bytes:
        """Ids of one pretoken."""
        out = self.words.get(word)
        if out is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LETTERS))
            out = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in tokens]).tobytes()
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def encode_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if len(chunk) > LONG_CHUNK:
            specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
            parts = re.split(f"({'|'.join(specials)})", text) if specials else [text]
            return b"".join(self.encode_text(m) for p in parts for m in ([p] if p and specials and re.fullmatch("|".join(specials), p) else self.pretoken.findall(p)))
        plain = PLAIN.fullmatch(text)
        if plain:
            out = (self.word("\n") if text[0] == "\n" else b"") + self.word((plain[1] or "") + plain[2]) + (self.word(plain[3]) if plain[3] else b"")
        else:
            out = self.encode_text(text)
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, data: bytes) -> Iterator[bytes]:
        """The ids of a text in pieces."""
        if not data.isascii() and OTHER_SPACE.search(data.decode("utf-8", "replace")):
            text = data.decode("utf-8", "replace")
            yield self[text.encode()] if len(data) > LONG_CHUNK else self.encode_text(text)
        else:
            yield b"".join(map(self.__getitem__, CHUNK.findall(data)))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """One for all tasks of a worker, so that what it remembers serves the next task."""
    return ChunkEncoder(path)


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tasks cannot ask for the cluster's default file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


class SequenceWriter:
    """One file of sequences; what is appended comes out cut into rows of ``length``."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int, end_id: int):
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema(
            [pa.field("ids", pa.list_(kind, length), nullable=False), pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)],
            metadata={"length": str(length), "batch_rows": str(rows), "end_id": str(end_id)},
        )
        self.dtype, self.length, self.rows, self.end_id = dtype, length, rows, end_id
        self.writer, self.waiting, self.held, self.n_ids, self.n_sequences = pa.ipc.new_file(sink, self.schema), [], 0, 0, 0

    def append(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids) // self.dtype.itemsize
        batch = self.rows * self.length * self.dtype.itemsize
        if self.held >= batch:
            data = b"".join(self.waiting)
            for at in range(0, len(data) - batch + 1, batch):
                self.write(np.frombuffer(data, dtype=self.dtype, count=self.rows * self.length, offset=at), self.rows * self.length)
            self.waiting = [data[len(data) // batch * batch :]]
            self.held = len(self.waiting[0])

    def write(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
        if len(rest):
            padded = np.full(-(-len(rest) // self.length) * self.length, self.end_id, dtype=self.dtype)
            padded[: len(rest)] = rest
            self.write(padded, len(rest))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file, and to any range of its ids."""

    def __init__(self, uri: str):
        files, path = open_folder(uri)
        source = pa.memory_map(path) if isinstance(files, arrow_fs.LocalFileSystem) else files.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        said = self.reader.schema.metadata
        self.length, self.rows = int(said[b"length"]), int(said[b"batch_rows"])
        self.n_batches = self.reader.num_record_batches
        self.at, self.view = -1, None  # the batch that was read last, as documents come in order

    def __len__(self) -> int:
        last = self.reader.get_batch(self.n_batches - 1).num_rows if self.n_batches else 0
        return max(0, self.n_batches - 1) * self.rows + last

    def flat(self, batch: int, column: int = 0) -> pa.Array:
        return self.reader.get_batch(batch).column(column).values

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence k: a view of the file."""
        return self.flat(k // self.rows).to_numpy(zero_copy_only=True)[k % self.rows * self.length :][: self.length]

    def mask(self, k: int) -> np.ndarray:
        """The mask of sequence k as packed bits, lowest first: a view of the file. The length is a multiple of eight, or a copy is made."""
        bits = np.frombuffer(self.flat(k // self.rows, 1).buffers()[1], dtype=np.uint8)
        at = k % self.rows * self.length
        if self.length % 8:
            return np.packbits(np.unpackbits(bits, bitorder="little")[at : at + self.length], bitorder="little")
        return bits[at // 8 : (at + self.length) // 8]

    def pieces(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids [start, start + length) of the file, in one view per batch that they lie in."""
        size = self.rows * self.length
        while length > 0:
            if start // size != self.at:
                self.at, self.view = start // size, self.flat(start // size).to_numpy(zero_copy_only=True)
            part = self.view[start % size :][:length]
            yield part
            start, length = start + len(part), length - len(part)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, length: int = SEQUENCE, batch_rows: int = BATCH_ROWS, parts: int | None = None,
) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest, one row per file in that order."""
    spark = docs.sparkSession
    path, folder = tokenizer or default_tokenizer(), qualified(spark, folder)
    files, inner = open_folder(folder)
    files.create_dir(inner, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).withColumn("tie", F.xxhash64("data"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    spread = data.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "data")
    index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files, inner = open_folder(folder)
        encoder = encoder_of(path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        n_docs = 0
        with files.open_output_stream(f"{inner}/{name}.ids.arrow") as ids_sink, files.open_output_stream(f"{inner}/{name}.docs.arrow") as docs_sink:
            writer = SequenceWriter(ids_sink, encoder.dtype, length, batch_rows, end_id)
            with pa.ipc.new_file(docs_sink, index) as places:
                for batch in slices(batches):
                    starts = []
                    for text in batch.column(1):
                        starts.append(writer.n_ids)
                        for piece in encoder.encode(text.as_py() or b""):
                            writer.append(piece)
                        writer.append(end)
                    at = np.array([*starts, writer.n_ids], dtype=np.int64)
                    places.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:-1]), pa.array(np.diff(at))], schema=index))
                    n_docs += batch.num_rows
            writer.close()
        if n_docs:
            row = (part, f"{folder}/{name}.ids.arrow", f"{folder}/{name}.docs.arrow", writer.n_ids, n_docs, writer.n_sequences)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    manifest = Scratch(spark, "tokens").store("manifest", spread.mapInArrow(run, MANIFEST))
    listed = {x.rsplit("/", 1)[-1] for r in manifest.collect() for x in (r.ids_path, r.docs_path)}  # two names per partition
    for info in files.get_file_info(arrow_fs.FileSelector(inner)):
        if info.type == arrow_fs.FileType.File and info.base_name not in listed:
            files.delete_file(info.path)
    return manifest


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and part of every document, from the files; a task reads one file at a time."""
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):  # one row per file
        rows.append((r.part, r.ids_path, r.docs_path, base))
        base += r.n_ids
    spark = manifest.sparkSession
    work = spark.createDataFrame(rows, "part int, ids_path string, docs_path string, base long").repartition(max(1, len(rows)), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                ids = SequenceFile(job["ids_path"])
                files, path = open_folder(job["docs_path"])
                with files.open_input_file(path) as source:
                    places = pa.ipc.open_file(source)
                    for k in range(places.num_record_batches):
                        doc_id, start, n = places.get_batch(k).columns
                        sums = np.empty(len(doc_id), dtype=np.int64)
                        for i, (at, size) in enumerate(zip(start.to_pylist(), n.to_pylist())):
                            crc = 0
                            for piece in ids.pieces(at, size):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            sums[i] = crc
                        base = pa.array(start.to_numpy() + job["base"])
                        yield pa.RecordBatch.from_arrays([doc_id, base, n, pa.array(sums), pa.array(np.full(len(n), job["part"], dtype=np.int32))], names=names)

    return work.mapInArrow(run, schema)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files in the shared folder, and read back from them."""
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_tokens(docs, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"))

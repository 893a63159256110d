"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Each task hashes the windows of its documents in chunks of a bounded number of words. Within a chunk, repeated
   windows are settled at once; what is left (each window once) is packed by hash range into binary blocks.
   A chunk makes at most 2 ** COARSE_BITS blocks, so that they do not shrink to a few windows as the corpus and its number of
   ranges grow. In a larger corpus these coarse ranges are split after a first shuffle: the blocks of some thousand chunks
   become one block for each fine range.
2. The blocks of one hash range meet (groupBy on the range). A window found in several chunks stays in the
   document with the smallest doc_id; its other places go back to their chunks as packed positions. A chunk sends a
   window once, so a window in a third of all documents costs one entry per chunk, not one per document.
3. The positions of a chunk merge into maximal removal intervals per document, and these join the texts.

The hash has 64 bits, so unequal windows meet with probability about n_windows**2 / 2**65.

Defined cases: null, empty and short texts have no windows and nothing is removed. Rows that share a doc_id are
not earlier than each other; a window that such a row repeats within itself is removed. A null doc_id counts as larger
than every other. Equal rows get equal results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_documents, runs, table, text_bytes, token_hashes, window_hashes

WINDOW = 20
CHUNK_WORDS = 2_000_000
#: Text bytes per hash range: some two million windows, and at most a few entries per chunk and window.
RANGE_BYTES = 8 << 20
#: Hash ranges that a chunk tells apart, as a power of two.
COARSE_BITS = 12
#: Chunks whose blocks of a coarse range are split together.
SPLIT_CHUNKS = 2048
NULL_ID = np.iinfo(np.int64).max

PACKED = "range long, chunk long, kind int, n long, hashes binary, places binary, starts binary, ids binary"


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def squeeze(values: np.ndarray) -> bytes:
    """Ascending integers as compressed differences."""
    return zlib.compress(np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype=np.int64))


def pack_chunk(chunk: int, rows: list[tuple[int, int, np.ndarray]], bits: int, window: int) -> list[tuple]:
    """Blocks of one chunk: rows are (doc_id, text hash, token hashes); kind 0 are windows, kind 1 is the directory."""
    rows.sort(key=lambda r: (r[0], r[1]))
    lengths = np.array([len(r[2]) for r in rows], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    h = window_hashes(np.concatenate([r[2] for r in rows]), window)
    row_of = np.repeat(np.arange(len(rows)), lengths)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + window <= (starts + lengths)[row_of])
    h = h[at]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    row = row_of[at]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.empty(0, dtype=np.int64)
    new_row = new.copy()
    new_row[1:] |= row[1:] != row[:-1]
    keep = new_row & (ids[row] == ids[row[first]])
    local = np.sort(at[~keep])
    h, at, row = h[keep], at[keep], row[keep]
    out = []
    if len(h):
        ranges = (h >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            gaps = np.diff(h[a:b], prepend=np.uint64(int(ranges[a]) << (64 - bits)))
            width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
            used = np.unique(row[a:b])
            out.append(
                (int(ranges[a]), chunk, 0, width, pack(gaps, width), pack(at[a:b], 4), squeeze(starts[used]), squeeze(ids[used]))
            )
    if len(local) or len(h):
        text_hashes = np.array([r[1] for r in rows], dtype=np.int64)
        out.append(
            (chunk % (1 << bits), chunk, 1, total, squeeze(local), text_hashes.tobytes(), squeeze(starts), squeeze(ids))
        )
    return out


def pack_windows(docs: DataFrame, bits: int, window: int, chunk_words: int) -> DataFrame:
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        rows, words, done = [], 0, 0

        def flush():
            nonlocal rows, words, done
            out = pack_chunk(base + done, rows, bits, window)
            rows, words, done = [], 0, done + 1
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out[i : i + 64]), kinds)], schema=schema)

        for batch in batches:
            for doc_id, text_hash, data in zip(*[c.to_pylist() for c in batch.columns]):
                tokens = token_hashes(data.split()) if data else ()
                if len(tokens) < window:
                    continue
                rows.append((NULL_ID if doc_id is None else doc_id, text_hash, tokens))
                words += len(tokens)
                if words >= chunk_words:
                    yield from flush()
        if rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), text_bytes()).mapInArrow(run, PACKED)


def entries(b: dict, i: int, bits: int) -> tuple[np.ndarray, ...]:
    """Hashes, places, document ids and chunks of the windows of a block: of one chunk (kind 0) or of several (kind 2)."""
    h = np.cumsum(unpack(b["hashes"][i], b["n"][i]), dtype=np.uint64) + np.uint64(b["range"][i] << (64 - bits))
    at = unpack(b["places"][i], 4).astype(np.int64)
    if b["kind"][i] == 2:
        return h, at, np.frombuffer(zlib.decompress(b["ids"][i]), dtype=np.int64), np.frombuffer(zlib.decompress(b["starts"][i]), dtype=np.int64)
    doc = np.searchsorted(unsqueeze(b["starts"][i]), at, side="right") - 1
    return h, at, unsqueeze(b["ids"][i])[doc], np.full(len(at), b["chunk"][i], dtype=np.int64)


def split_range(coarse: int, bits: int):
    """Blocks of some chunks and one coarse range, as one block for each fine range."""

    def fn(batch: pa.Table) -> pa.Table:
        b = batch.to_pydict()
        names = [x.split()[0] for x in PACKED.split(", ")]
        out = [[b[c][i] for c in names] for i, kind in enumerate(b["kind"]) if kind == 1]
        got = [entries(b, i, coarse) for i, kind in enumerate(b["kind"]) if kind == 0]
        if got:
            h, at, ids, chunks = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(h, kind="stable")
            h, at, ids, chunks = h[order], at[order], ids[order], chunks[order]
            ranges = (h >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
            for a, z in zip(edges[:-1], edges[1:]):
                gaps = np.diff(h[a:z], prepend=np.uint64(int(ranges[a]) << (64 - bits)))
                width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                more = (zlib.compress(x[a:z].tobytes(), 1) for x in (chunks, ids))
                out.append([int(ranges[a]), -1, 2, width, pack(gaps, width), pack(at[a:z], 4), *more])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, type=k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names=names)

    return fn


def settle_range(bits: int):
    """Windows of one hash range that several chunks hold: which places are not the first."""

    def fn(batch: pa.Table) -> pa.Table:
        b = batch.to_pydict()
        out = {k: [] for k in ("chunk", "kind", "n", "places", "text_hashes", "starts", "ids")}

        def put(*row):
            for k, v in zip(out, row):
                out[k].append(v)

        got = []
        for i, kind in enumerate(b["kind"]):
            if kind == 1:
                put(b["chunk"][i], 1, b["n"][i], b["hashes"][i], b["places"][i], b["starts"][i], b["ids"][i])
            else:
                got.append(entries(b, i, bits))
        if got:
            h, at, ids, chunks = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(h)
            h = h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(new)
            group_ids = ids[order]
            least = np.minimum.reduceat(group_ids, begin)[np.cumsum(new) - 1]
            late = order[group_ids > least]
            late = late[np.argsort(chunks[late], kind="stable")]
            cuts = np.flatnonzero(np.diff(chunks[late])) + 1
            for part in np.split(late, cuts) if len(late) else ():
                put(int(chunks[part[0]]), 0, 0, squeeze(np.sort(at[part])), None, None, None)
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, type=k) for v, k in zip(out.values(), kinds)], names=list(out))

    return fn


SETTLED = "chunk long, kind int, n long, places binary, text_hashes binary, starts binary, ids binary"


def chunk_intervals(window: int):
    """Removal intervals per document of one chunk, from its own and the returned positions."""

    def fn(batch: pa.Table) -> pa.Table:
        b = batch.to_pydict()
        main = b["kind"].index(1)
        total, starts, ids = b["n"][main], unsqueeze(b["starts"][main]), unsqueeze(b["ids"][main])
        text_hashes = np.frombuffer(b["text_hashes"][main], dtype=np.int64)
        steps = np.zeros(total + window + 1, dtype=np.int32)
        for places in b["places"]:
            p = unsqueeze(places)
            steps[p] += 1
            steps[p + window] -= 1
        lo, hi = runs(np.cumsum(steps[:total]) > 0)
        # a run may go on into the next document of the chunk
        inner = np.repeat(np.arange(len(lo)), np.searchsorted(starts, hi) - np.searchsorted(starts, lo, side="right") + 1)
        first = np.ones(len(inner), dtype=bool)
        first[1:] = inner[1:] != inner[:-1]
        nth = np.arange(len(inner)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(inner) else inner
        doc = np.searchsorted(starts, lo, side="right")[inner] - 1 + nth
        ends = np.append(starts[1:], total)
        a = np.maximum(lo[inner], starts[doc]) - starts[doc]
        z = np.minimum(hi[inner], ends[doc]) - starts[doc]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        docs = doc[np.append(0, cuts)] if len(doc) else doc
        return pa.table(
            [
                pa.array([None if i == NULL_ID else int(i) for i in ids[docs]], type=pa.int64()),
                pa.array(text_hashes[docs]),
                pa.array([x.tolist() for x in np.split(a, cuts)] if len(doc) else [], type=pa.list_(pa.int32())),
                pa.array([x.tolist() for x in np.split(z, cuts)] if len(doc) else [], type=pa.list_(pa.int32())),
            ],
            names=["doc_id", "text_hash", "starts", "ends"],
        )

    return fn


def range_bits(size: int, range_bytes: int = RANGE_BYTES) -> int:
    """log2 of the number of hash ranges for texts of ``size`` bytes."""
    return max(3, int(size // range_bytes).bit_length())


def removal_intervals(
    docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS, range_bytes: int = RANGE_BYTES, coarse_bits: int = COARSE_BITS
) -> DataFrame:
    """doc_id, text_hash, starts, ends: maximal word intervals to remove, for documents that have any."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(size, range_bytes)
    packed = pack_windows(docs, min(bits, coarse_bits), window, chunk_words)
    if bits > coarse_bits:
        groups = F.lit(max(1, size // (6 * chunk_words * SPLIT_CHUNKS)))
        together = packed.withColumn("part", F.pmod(F.xxhash64("chunk"), groups))
        packed = together.groupBy("range", "part").applyInArrow(split_range(coarse_bits, bits), PACKED)
    settled = packed.groupBy("range").applyInArrow(settle_range(bits), SETTLED)
    found = settled.groupBy("chunk").applyInArrow(
        chunk_intervals(window), "doc_id long, text_hash long, starts array<int>, ends array<int>"
    )
    # stored, so that the blocks are off the disks before the texts are shuffled
    return Scratch(docs.sparkSession, "intervals").store("found", found)


def removed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document."""
    found = removal_intervals(docs, **options).dropDuplicates(["doc_id", "text_hash"])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("th"))
    joined = texts.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash")), "left")
    return joined.select(F.col("id").alias("doc_id"), "text", "starts", "ends")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        def fn(ids, texts, starts, ends):
            out = []
            for doc_id, data, lo, hi in zip(ids, texts, starts, ends):
                words = (data or b"").split()
                n, kept, at = len(words), [], 0
                for a, z in zip(lo or (), hi or ()):
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                out.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            return list(zip(*out)) if out else [[]] * 4

        return fn

    return map_documents(
        removed(table(spark, sf_dir, "documents")), ("doc_id", text_bytes(), "starts", "ends"),
        "doc_id long, n_words long, n_removed long, kept_sha256 string", build,
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, doc_id, i, ws[i:i+19] AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(k, ' '))) AS lo, row_number() OVER (PARTITION BY r, md5(array_to_string(k, ' ')) ORDER BY i) AS n FROM g) WHERE doc_id > lo OR n > 1),
c AS (SELECT DISTINCT r, i + o AS p FROM f, (SELECT unnest(range(0, 20)) AS o)),
w AS (SELECT r, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT w.r, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (c.p IS NULL) AS kept FROM w LEFT JOIN c ON w.r = c.r AND w.p = c.p GROUP BY w.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

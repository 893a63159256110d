"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The test strings are the windows of ``window`` consecutive words of every benchmark item (a shorter item is one
window). Patterns of one length form one table: a shift for every block of two words tells how far the search may move;
at shift 0 the suffix block selects a bucket of test strings, which are compared directly. Words are compared as
bytes, so there are no false occurrences.

The tables are built from at most ``BLOCK_BYTES`` of benchmark text, which is all that the driver and the tasks hold of it; a larger
benchmark is searched in blocks of that size, one after the other, over the same rows (no shuffle, no join). What a block found
is stored before the next one is fetched.

Null or empty documents have no words and no hits; null or empty items have no windows. Equal items are separate items.
Rows are judged one by one, so repeated rows get equal results. A null item_id counts as an item and is left out of the
joined ids. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, covered, filter_documents, item_words, map_documents, runs, table, text_bytes

WINDOW = 10
BLOCK_BYTES = 8 << 20


class WuManber:
    """Patterns of one length, as tuples of words; each holds the items that it comes from."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[key].append((words, items))

    def search(self, words: list[bytes], hits: list[int], items: set[int]) -> None:
        """Adds the starts of occurrences to hits and their items to items."""
        n, length, far, shift = len(words), self.length, self.far, self.shift.get
        end = length - 1
        single = self.block == 1
        while end < n:
            key = words[end] if single else (words[end - 1], words[end])
            step = shift(key, far)
            if step:
                end += step
                continue
            here = tuple(words[end - length + 1 : end + 1])
            for pattern, found in self.buckets[key]:
                if pattern == here:
                    hits.append(end - length + 1)
                    items.update(found)
            end += 1


def build_tables(texts: list[bytes | None], window: int = WINDOW) -> list[WuManber]:
    """One table per pattern length; items are numbered by their place in ``texts``."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for k, data in enumerate(texts):
        words = item_words(data or b"")
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            found = by_length[length][tuple(words[i : i + length])]
            if not found or found[-1] != k:
                found.append(k)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks of the benchmark, and the blocks, each fetched when it is asked for."""
    items = items.select(F.col("item_id").cast("long"), text_bytes())
    size = items.agg(F.sum(F.length("data"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    place = F.pmod(F.xxhash64("item_id", "data"), F.lit(n))
    return n, ((items.filter(place == k) if n > 1 else items).collect() for k in range(n))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, starts, ends (maximal hit intervals) and items (ids with an occurrence) per document."""
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<long>"
    none = F.array().cast("array<int>")
    out = docs.select(
        F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"),
        F.array().cast("array<long>").alias("items"), text_bytes(),
    )
    n, blocks = item_blocks(benchmark, block_bytes)
    scratch = Scratch(docs.sparkSession, "hits")
    for k, block in enumerate(blocks):
        last = k == n - 1
        shared = sc.broadcast([(r[0], r[1]) for r in block])

        def build(shared=shared, last=last):
            ids = [r[0] for r in shared.value]
            tables = build_tables([r[1] for r in shared.value], window)

            def fn(doc_ids, counts, lows, highs, known, texts):
                cols = [doc_ids, [], [], [], [], *([] if last else [texts])]
                for data, lo, hi, have in zip(texts, lows, highs, known):
                    words = item_words(data or b"")
                    found: set[int] = set()
                    mask = np.zeros(len(words), dtype=bool) if lo else None
                    for a, z in zip(lo, hi):
                        mask[a:z] = True
                    for t in tables:
                        hits: list[int] = []
                        t.search(words, hits, found)
                        if hits:
                            cover = covered(np.array(hits), t.length, len(words))
                            mask = cover if mask is None else mask | cover
                    if mask is not None:
                        lo, hi = (x.tolist() for x in runs(mask))
                    cols[1].append(len(words))
                    cols[2].append(lo)
                    cols[3].append(hi)
                    cols[4].append(have + [ids[k] for k in sorted(found)] if found else have)
                return cols

            return fn

        out = map_documents(out, out.columns, schema if last else f"{schema}, data binary", build)
        if not last:
            out = scratch.store(str(k), out)
            shared.unpersist()
            if k:
                scratch.drop(str(k - 1))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    n, blocks = item_blocks(benchmark, block_bytes)
    scratch = Scratch(docs.sparkSession, "clean")
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast([r[1] for r in block])

        def build(shared=shared):
            tables = build_tables(shared.value, window)

            def clean(data: bytes | None) -> bool:
                words, hits = item_words(data or b""), []
                for t in tables:
                    t.search(words, hits, set())
                return not hits

            return lambda texts: list(map(clean, texts))

        docs = filter_documents(docs, build)
        if k < n - 1:
            docs = scratch.store(str(k), docs)
            shared.unpersist()
            if k:
                scratch.drop(str(k - 1))
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The per-document digest of find_hits()."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT q, item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT l FROM p),
g AS (SELECT r, l, i, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, n WHERE len(ws) >= l)),
h AS (SELECT r, g.l, i, q, item_id FROM g JOIN p ON g.l = p.l AND g.k = p.k),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, q, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

"""Suffix-array dedup: sparse suffix arrays over words.

Only suffixes at content-selected positions are kept: the minimisers, the smallest hash of ``GRAM`` words in each window of
``SPAN`` consecutive ones. A passage of MIN_WORDS >= GRAM + SPAN - 1 words that occurs twice holds the same minimisers both
times. Gram hashes are counted in Spark; suffixes whose gram occurs once are dropped.

A gram with at most NEIGHBOURS + 1 suffixes is one run in sorted order, and each of its suffixes is compared with all others and
extended to the right and to the left; a match of at least MIN_WORDS words marks the span of both. Such a suffix carries
MIN_WORDS + GRAM words from its place on and MIN_WORDS - GRAM before it. Minimisers are at most SPAN words apart, so that is
enough to prove a match and to reach its ends; longer passages are the union of the matches of their minimisers.

A gram with more suffixes (a line in a third of all documents) has no order in which all partners are near: a match may begin at
any of the SPAN places up to the gram. There one suffix for each start is sorted instead of the minimiser's own. A start belongs
to the minimiser of its first MIN_WORDS words only, so equal passages have equal starts and none comes twice. These suffixes are
ordered by the 64-bit hash of their first MIN_WORDS words, as nothing but equality counts: equal ones are contiguous, so one
neighbour on each side decides. They are range-partitioned, so that also many equal ones are split between tasks; neighbours at
the edges of partitions are compared in a second, small step.

Of two occurrences the one with the smaller (doc_id, text hash, place) is the earlier. All of them are marked as repeated; those of
which an earlier one exists are also spans to cut, so that cutting leaves each passage once.

Null, empty and short texts have no suffixes and no spans. Rows that repeat doc_id and text count as one document here. Rows without
a doc_id are ordered like the id -1, are kept apart by their text and never taken for a document that has an id. Repeats inside one
document count too, unless they overlap themselves completely.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_documents, only_likely, runs, table, text_bytes, token_hashes, window_hashes

MIN_WORDS = 50
GRAM = 20
NEIGHBOURS = 4
SPAN = MIN_WORDS - GRAM + 1


def owners(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each window of ``span`` hashes (one window if there are fewer), the position of its smallest, the last of equal ones."""
    span = min(span, len(h))
    # sliding minimum by doubling: least[i] = place of the minimum of h[i : i + width]
    place = np.arange(len(h))
    width = 1
    while 2 * width <= span:
        a, b = place[:-width], place[width:]
        place = np.where(h[a] < h[b], a, b)
        width *= 2
    if width < span:
        a, b = place[: len(h) - span + 1], place[span - width : len(h) - width + 1]
        place = np.where(h[a] < h[b], a, b)
    return place


def minimisers(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the smallest hash (the last of equal ones) in every window of ``span`` hashes."""
    return np.unique(owners(h, span))


def text_key() -> Column:
    """A hash of the text that differs between rows with and without a doc_id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("no id"))).otherwise(F.xxhash64("text"))


def suffix_grams(docs: DataFrame, gram: int, span: int) -> DataFrame:
    """doc_id, text_hash, gram, at: the sampled suffixes of each text that is long enough for a match."""

    def build():
        def fn(ids, hashes, texts):
            cols = ([], [], [], [])
            for doc_id, text_hash, data in zip(ids, hashes, texts):
                h = window_hashes(token_hashes((data or b"").split()), gram)
                at = minimisers(h if len(h) >= span else h[:0], span)
                cols[0].append(np.full(len(at), doc_id if doc_id is not None else -1, dtype=np.int64))
                cols[1].append(np.full(len(at), text_hash, dtype=np.int64))
                cols[2].append(h[at].view(np.int64))
                cols[3].append(at.astype(np.int32))
            empty = [np.empty(0, dtype=np.int64)]
            out = [np.concatenate(c or empty) for c in cols]
            return [pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), pa.array(out[3].astype(np.int32))]

        return fn

    return map_documents(
        docs, (F.col("doc_id").cast("long"), text_key().alias("text_hash"), text_bytes()),
        "doc_id long, text_hash long, gram long, at int", build,
    )


def shared_prefix(a: bytes, b: bytes, width: int = 4) -> int:
    """Number of leading words (of ``width`` bytes) that two packed word sequences share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // width
    x, y = np.frombuffer(a[:n], dtype=np.uint32), np.frombuffer(b[:n], dtype=np.uint32)
    return int(np.argmax(x != y))


SPANS = "doc_id long, text_hash long, lo int, hi int, later boolean"
#: For each text: its suffixes of rare grams with their contexts, and its starts under frequent grams with the hashes of their windows.
PLACED = "doc_id long, text_hash long, grams array<long>, ats array<int>, rights array<binary>, lefts array<binary>, starts array<int>, windows array<long>"


def contexts(scratch: Scratch, docs: DataFrame, places: DataFrame, gram: int, min_words: int) -> DataFrame:
    """PLACED rows. A rare suffix comes with the 32-bit hashes of the words from its place on, and of those before it (nearest first)."""
    wanted = places.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("at", "gram", "many"))).alias("s"))
    wanted = scratch.store("wanted", wanted.select("doc_id", "text_hash", F.col("s.at").alias("ats"), F.col("s.gram").alias("grams"), F.col("s.many").alias("many")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), text_key().alias("text_hash"), "text")
    texts = only_likely(texts, "text_hash", wanted)
    joined = texts.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])

    def build():
        def fn(ids, hashes, texts, ats, grams, many):
            for doc_id, text_hash, data, at, gs, ms in zip(ids, hashes, texts, ats, grams, many):
                words = token_hashes(data.split())
                tokens = (words >> np.uint64(32)).astype(">u4")
                back, n = tokens[::-1], len(tokens)
                rare = [(i, g) for i, g, m in zip(at, gs, ms) if not m]
                starts, windows = [], []
                if any(ms):
                    own = owners(window_hashes(words, gram), min_words - gram + 1)
                    starts = np.flatnonzero(np.isin(own, [i for i, m in zip(at, ms) if m])).astype(np.int32)
                    windows = window_hashes(words, min_words)[starts].view(np.int64)
                yield [
                    [doc_id], [text_hash], [[g for _, g in rare]], [[i for i, _ in rare]],
                    [[tokens[i : i + min_words + gram].tobytes() for i, _ in rare]],
                    [[back[n - i : n - i + min_words - gram].tobytes() for i, _ in rare]], [starts], [windows],
                ]

        return fn

    return map_documents(joined, ("doc_id", "text_hash", text_bytes(), "ats", "grams", "many"), PLACED, build)


def pair_spans(a: tuple, b: tuple, least: int) -> list[tuple]:
    """Spans of two suffixes, given as rows of doc_id, text_hash, gram, at, right, left; whether each is the later one."""
    if a[2] != b[2]:
        return []
    left, right = shared_prefix(a[5], b[5]), shared_prefix(a[4], b[4])
    if left + right < least:
        return []
    a, b = sorted((a, b), key=lambda x: (x[0], x[1], x[3]))
    return [(x[0], x[1], x[3] - left, x[3] + right, x is b) for x in (a, b)]


def compare_rare(least: int):
    """Compare each suffix of a partition sorted by gram with those of its gram before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = deque(maxlen=NEIGHBOURS)
        for batch in batches:
            out = []
            for now in zip(*[c.to_pylist() for c in batch.columns]):
                for other in before:
                    out += pair_spans(other, now, least)
                before.append(now)
            cols = list(zip(*sorted(set(out)))) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "text_hash", "lo", "hi", "later"])

    return run


START = ["doc_id", "text_hash", "at", "window"]
#: Starts with an equal neighbour (edge 0; later: with one before it), and the first and last of a sorted partition (edge 1 and 2) with
#: the partition's number.
COMPARED = "doc_id long, text_hash long, at int, window long, later boolean, edge int, part int"


def compare_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each start of a partition sorted by window with the next; the partition's first and last start come out too."""
    part, first, last = TaskContext.get().partitionId(), None, None

    def made(rows: pa.Table, edge: int, later: np.ndarray | None = None) -> list[pa.RecordBatch]:
        rows = rows.append_column("later", pa.array(np.zeros(rows.num_rows, dtype=bool) if later is None else later))
        for name, value in (("edge", edge), ("part", part)):
            rows = rows.append_column(name, pa.array([value] * rows.num_rows, type=pa.int32()))
        return rows.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch.select(START)])
        first = rows.slice(0, 1) if first is None else first
        rows = rows if last is None else pa.concat_tables([last, rows])
        window = rows["window"].to_numpy()
        equal = np.concatenate(([False], window[1:] == window[:-1], [False]))
        some = equal[1:] | equal[:-1]
        yield from made(rows.filter(pa.array(some)), 0, equal[:-1][some])
        last = rows.slice(rows.num_rows - 1)
    if last is not None:
        yield from made(first, 1)
        yield from made(last, 2)


def repeated_starts(scratch: Scratch, starts: DataFrame, min_words: int) -> DataFrame:
    """SPANS of the starts whose first ``min_words`` words occur at another start too."""
    order = ["window", "doc_id", "text_hash", "at"]
    parts = max(1, int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = starts.select(*START).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    compared = scratch.store("compared", ordered.mapInArrow(compare_starts, COMPARED))

    # two rows of each partition: its last, and the first of the next partition that has rows
    key = F.struct(*START)
    edges = compared.filter("edge > 0").groupBy("part").agg(
        F.max(F.when(F.col("edge") == 1, key)).alias("lo"), F.max(F.when(F.col("edge") == 2, key)).alias("hi")
    )
    after = Window.orderBy("part").rowsBetween(1, 1)
    pairs = edges.select(F.col("hi").alias("a"), F.first("lo").over(after).alias("b")).filter("a.window = b.window")
    border = pairs.select("a.*", F.lit(False).alias("later")).unionByName(pairs.select("b.*", F.lit(True).alias("later")))
    found = compared.filter("edge = 0").select(*START, "later").unionByName(border)
    return found.select("doc_id", "text_hash", F.col("at").alias("lo"), (F.col("at") + min_words).alias("hi"), "later")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, starts, ends, cut_starts, cut_ends: merged spans that occur elsewhere too, and those that occur earlier.

    Only documents that have any. Intermediate tables are dropped as soon as the next one is stored.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    found = scratch.store("found", suffix_grams(docs, gram, min_words - gram + 1))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = scratch.store("repeated", counts.select("gram", (F.col("n") > NEIGHBOURS + 1).alias("many")))
    placed = scratch.store("placed", contexts(scratch, docs, found.join(repeated, "gram"), gram, min_words))
    scratch.keep("placed")

    rows = placed.select("doc_id", "text_hash", F.inline(F.arrays_zip("grams", "ats", "rights", "lefts")))
    rare = scratch.store("rare", rows.repartition("grams").sortWithinPartitions("grams").mapInArrow(compare_rare(min_words), SPANS))
    starts = placed.select("doc_id", "text_hash", F.inline(F.arrays_zip("starts", "windows")))
    frequent = repeated_starts(scratch, starts.withColumnsRenamed({"starts": "at", "windows": "window"}), min_words)
    both = rare.unionByName(frequent)
    merged = both.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi", "later")).alias("s"))

    def build():
        def fn(ids, hashes, lows, highs, laters):
            cols = tuple([] for _ in range(6))
            for doc_id, text_hash, lo, hi, later in zip(ids, hashes, lows, highs, laters):
                marks = np.zeros((2, max(hi)), dtype=bool)
                for a, z, again in zip(lo, hi, later):
                    marks[0, a:z] = True
                    if again:
                        marks[1, a:z] = True
                for col, x in zip(cols, (doc_id, text_hash, *(x.tolist() for m in marks for x in runs(m)))):
                    col.append(x)
            return list(cols)

        return fn

    spans = map_documents(
        merged, ("doc_id", "text_hash", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.col("s.later").alias("later")),
        "doc_id long, text_hash long, starts array<int>, ends array<int>, cut_starts array<int>, cut_ends array<int>", build,
    )
    spans = scratch.store("spans", spans)
    scratch.keep("spans")
    return spans


SPAN_COLUMNS = ("starts", "ends", "cut_starts", "cut_ends")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, n_repeated, n_cut and the spans of every document: its words within repeated passages, and within later occurrences."""
    spans = repeated_spans(docs, min_words, gram).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("th"))
    same = (F.coalesce("doc_id", F.lit(-1)) == F.col("id")) & (F.col("th") == F.col("text_hash"))
    none = F.array().cast("array<int>")
    out = rows.join(spans, same, "left").select("doc_id", *(F.coalesce(c, none).alias(c) for c in SPAN_COLUMNS))
    length = lambda lo, hi: F.aggregate(F.zip_with(lo, hi, lambda a, z: z - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", length("starts", "ends").alias("n_repeated"), length("cut_starts", "cut_ends").alias("n_cut"), *SPAN_COLUMNS)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))

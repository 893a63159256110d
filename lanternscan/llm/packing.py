"""Best-fit packing of documents into sequences by swap-based local search.

Documents become token ids (one map pass), longer ones are cut into pieces of the capacity, and pieces of exactly
the capacity fill a sequence alone. The others are dealt by a hash into groups of some ``GROUP_ITEMS`` pieces. Each group
is packed by best fit and then improved: moves, one-for-one and two-for-one exchanges between underfull bins that raise
the sum of squared fills, so that full bins grow fuller until others empty. Bins that stay underfull are dealt
out again into groups and packed again, in ``ROUNDS`` rounds of shrinking size, so that waste does not
grow with the number of groups.

A null text is an empty one: its only id is the closing 0. Rows that share a doc_id are separate documents. Equal sizes
are taken in the order of (doc_id, piece). An empty table gives no sequences.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_documents, table, text_bytes

CAPACITY = 2048
GROUP_ITEMS = 8192
ROUNDS = 3
#: Bins at least this full are left as they are after a round.
FULL_SHARE = 0.999
#: Words whose ids a task remembers; about 150 bytes each.
CACHE_WORDS = 600_000
END = struct.pack("<I", 0)
#: A word and the marks behind it, which are a token of their own.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of a text as little-endian bytes. Words between ASCII white space never share a token, so ids are kept by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}

    def part(self, piece: str) -> bytes:
        out = self.parts.get(piece)
        if out is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            out = self.parts[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return out

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        # lower-case Latin-1 letters are composed already and lower-case one by one
        m = PLAIN.fullmatch(low) if text.isascii() or max(text) < "Ā" else None
        if m:
            out = self.part(m[1]) + (self.part(m[2]) if m[2] else b"")
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def encode(self, data: bytes | None) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, (data or b"").split())) + END


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def build():
        encoder = Encoder(path)

        def fn(ids, texts):
            out = ([], [], [], [], [])
            for doc_id, data in zip(ids, texts):
                blob = encoder.encode(data)
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    for col, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            return list(out)

        return fn

    return map_documents(
        docs, (F.col("doc_id").cast("long"), text_bytes()),
        "doc_id long, piece int, start long, length long, ids_crc32 long", build,
    )


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over integer sizes; bins of one fill are kept in a stack."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_now: list[int] = []  # ascending distinct free amounts that have bins
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(free_now, size)
        if at < len(free_now):
            free = free_now[at]
            b = by_free[free].pop()
            if not by_free[free]:
                free_now.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - size
        if left:
            if not by_free[left]:
                insort(free_now, left)
            by_free[left].append(b)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, passes: int = 4) -> list[list[int]]:
    """Local search between underfull bins.

    From the emptiest bin on, each tries to fill the others: move an item, exchange one for one or two for one, taking for
    each receiving bin the change that leaves it fullest. A receiver never gets less full and a giver never fuller
    than the receiver was, so the sum of squared fills rises with every change.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(passes):
        changed = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__)
        for giver in under:
            for taker in reversed(under):
                gap = capacity - fill[taker]
                if taker == giver or not gap or not bins[giver] or fill[taker] < fill[giver]:
                    continue
                best, change = 0, None
                mine = sorted(bins[giver], key=size.__getitem__)
                weights = [size[i] for i in mine]
                at = bisect_left(weights, gap + 1) - 1
                if at >= 0:
                    best, change = weights[at], ((mine[at],), ())
                for back in sorted(set(bins[taker]), key=size.__getitem__):
                    room = gap + size[back]
                    at = bisect_left(weights, room + 1) - 1
                    if at >= 0 and weights[at] - size[back] > best:
                        best, change = weights[at] - size[back], ((mine[at],), (back,))
                    low, high = 0, len(mine) - 1
                    while low < high:  # the pair of mine that comes closest to the room
                        pair = weights[low] + weights[high]
                        if pair <= room:
                            if pair - size[back] > best:
                                best, change = pair - size[back], ((mine[low], mine[high]), (back,))
                            low += 1
                        else:
                            high -= 1
                    if best == gap:
                        break
                if change:
                    give, back = change
                    bins[giver] = [i for i in bins[giver] if i not in give] + list(back)
                    bins[taker] = [i for i in bins[taker] if i not in back] + list(give)
                    fill[giver] -= best
                    fill[taker] += best
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_group(sizes: np.ndarray, capacity: int, near: int = 96) -> list[list[int]]:
    """Best fit, then local search within windows of underfull bins (the emptiest with the fullest)."""
    bins = best_fit(sizes, capacity)
    size = sizes.tolist()
    fill = {k: sum(size[i] for i in b) for k, b in enumerate(bins)}
    under = sorted((k for k in fill if fill[k] < capacity), key=fill.__getitem__)
    done = [b for k, b in enumerate(bins) if fill[k] == capacity]
    groups = max(1, len(under) // near)
    for g in range(groups):
        done += improve([bins[k] for k in under[g::groups]], sizes, capacity)
    return done


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, length, row -> sequence_id and offset for items shorter than the capacity. Each round is a table in ``scratch``.

    Each round deals the pieces of bins that are still underfull into groups by a hash; ``part`` (the partition, then the last
    sequence) keeps equal rows apart.
    """
    full = int(capacity * FULL_SHARE)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"

    def of_round(r: int):
        def fn(key, group):
            ties = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
            group = group.sort_by(ties)
            bins = pack_group(group["length"].to_numpy(), capacity)
            counts = np.array([len(b) for b in bins])
            begin = np.cumsum(counts) - counts
            group = group.take(pa.array([i for b in bins for i in b]))
            placed = group["length"].to_numpy()
            ends = np.cumsum(placed)
            sequence = (np.int64(r) << 58) | (np.int64(key[0].as_py()) << 24) | np.repeat(np.arange(len(bins)), counts)
            added = (sequence, ends - placed - np.repeat((ends - placed)[begin], counts), np.repeat(np.add.reduceat(placed, begin), counts))
            group = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            for name, values in zip(("sequence_id", "offset", "fill"), added):
                group = group.append_column(name, pa.array(values, type=pa.int64()))
            return group

        return fn

    done, rest = None, items
    for r in range(rounds):
        n = rest.count()
        groups = -(-n // group_items)
        last = r == rounds - 1 or groups <= 1
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "part", F.lit(r)), F.lit(max(1, groups)))
        packed = scratch.store(f"round-{r}", rest.withColumn("group", salt).groupBy("group").applyInArrow(of_round(r), schema))
        kept = packed if last else packed.filter(F.col("fill") >= full)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rest = packed.filter(F.col("fill") < full).withColumnRenamed("sequence_id", "part").drop("offset", "fill")
    return done.drop("fill")


def packed_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """Every piece with its sequence_id and offset; the one table that stays of the job."""
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = scratch.store("pieces", pieces(docs, tokenizer, capacity))
    whole = cuts.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": (F.monotonically_increasing_id() + F.lit(1)) * F.lit(-1), "offset": F.lit(0).cast("long")}
    )
    rest = cuts.filter(F.col("length") < capacity).withColumn("part", F.spark_partition_id())
    placed = scratch.store("placed", whole.unionByName(pack(rest, scratch, capacity, group_items)))
    scratch.keep("placed")
    return placed


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))

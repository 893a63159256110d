"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. One pass makes a set of shingle hashes of each document, and the keys of its tiles. Equal sets form a class, which is one node.
2. Sets are banded by size. Two sets that reach the similarity differ in at most d shingles. Shingles are dealt by a hash into
   so many parts that, in a usual set, more than d are not empty; then one part that is not empty is equal in both sets, and its
   content is the key of a common tile. A set near the upper end of its band also takes part in the next band. A set with too
   few filled parts (a short one) adds its d + 1 smallest shingles as keys: two such sets that overlap share one. So no link is
   lost, and empty parts lead nowhere.
3. A tile is the sets that share a key with its smallest member. Sets enter their tiles as hashed bitmaps of two to four bits per
   shingle, which fold to a common width. Sets in a compatible size range are compared: bits that only one set has bound the
   overlap from above. Only sets of pairs that pass come themselves, as sorted arrays, and are intersected exactly. A pair that
   is already connected is not compared.
4. A tile of more than ``BLOCK`` sets (fewer, if they are large) is dealt into blocks; up to ``HEADS`` members, the heads, stand in each. That connects near copies by the thousand in
   linear time. Up to ``BLOCK`` members that are then apart from the tile's largest component are compared with all of the tile. If
   more are apart (a template with different contents, a passage in a third of all documents), what the members share with
   the heads has told nothing. So their rests, without the heads' shingles, get keys of their own and meet in smaller tiles,
   level by level; each level takes some shingle from every rest, so this ends.
   Pairs whose rests share nothing can only reach the similarity if both rests are small; of those with the same overlap with
   the heads, the one with the smallest rest stands for all (who reaches any of them reaches it), and only it is compared.
5. Links make components; only spanning links are kept, never all pairs of a group.

Null and empty texts have no shingles and are linked with nothing; texts with fewer words than a shingle have one. Rows that
share a doc_id are one node of ``near_duplicates``, and separate documents for ``keep_one_per_group``. A null doc_id is linked
with nothing and has a null component. Repeated rows are equal sets. Sets are told apart by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, MIX, Scratch, map_documents, only_likely, table, text_bytes, token_hashes, window_hashes
from .components import components

SHINGLE = 3
PERCENT = 90
#: Sets of a tile that are compared in one task, as bitmaps of some hundred bytes; of sets of more than LARGE shingles fewer.
BLOCK = 2048
LARGE = 4096
BAND_RATIO = 1.3
#: Salts of the small side where large tiles are looked up, so that one tile does not meet in one task.
SALTS = 16
#: Heads of a large tile. What a third of its members share is very likely in one of them.
HEADS = 8
#: Sets that a task remembers, so that it sends the keys of equal sets once.
SEEN = 200_000


@lru_cache(maxsize=4)
def bands(percent: int = PERCENT) -> tuple[np.ndarray, list[int], list[int]]:
    """First size, most differing shingles of a linked pair, and number of parts of each band."""
    ratio = max(BAND_RATIO, 100 / percent)
    starts = [1]
    while starts[-1] < 1 << 34:
        starts.append(max(starts[-1] + 1, int(np.ceil(starts[-1] * ratio))))
    most, parts = [], []
    for low, end in zip(starts, starts[1:]):
        d = 2 * (end - 1) * (100 - percent) // (100 + percent)  # both sizes are below the end
        n, p = max(1, low * percent // 100), d + 1
        # parts until the smallest set of the band fills more than d of them, but for two deviations
        while p < 2 * d + 1 and p - p * np.exp(-n / p) - 2 * np.sqrt(p * np.exp(-n / p)) < d + 1:
            p += max(1, p // 64)
        most.append(d)
        parts.append(p)
    return np.array(starts), most, parts


def shingle_set(data: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased."""
    words = (data or b"").lower().split()
    return np.unique(window_hashes(token_hashes(words), min(k, len(words)))) if words else np.empty(0, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def set_key(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def allowed(size: int, percent: int) -> int:
    """Most shingles in which a set of this size may differ from one that it is linked with."""
    return size * (100 - percent) // percent


def tile_keys(s: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of the tiles of ``s``, a set of ``size`` shingles or what is left of it; two linked sets whose rests overlap share one."""
    if not len(s):
        return s
    starts, most, parts = bands(percent)
    band = int(np.searchsorted(starts, size, side="right")) - 1
    place, value = mix(s), mix(s ^ BASE)
    out, enough_filled = [], True
    for b in [band] + [band + 1] * (size * 100 >= int(starts[band + 1]) * percent):
        at = (place % np.uint64(parts[b])).astype(np.int64)
        order = np.argsort(at, kind="stable")
        filled, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(value[order], first)
        out.append(mix(sums * BASE + filled.astype(np.uint64) + np.uint64(b << 40)))
        enough_filled &= len(filled) > most[b]
    if not enough_filled:
        out.append(mix(s[: allowed(size, percent) + 1] ^ MIX))
    return np.concatenate(out)


def enough(common, n, m, percent: int = PERCENT):
    return 100 * common >= percent * (n + m - common)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A hashed bitmap of a set with two to four bits per element, at least 64 and at most 2**18."""
    bits = 1 << min(18, max(6, int(2 * len(s) - 1).bit_length()))
    out = np.zeros(bits // 64, dtype=np.uint64)
    at = (mix(s) >> np.uint64(20)) % np.uint64(bits)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """The bitmaps at the width of the smallest: places are hashes modulo a power of two, so halves are united."""
    width = min(map(len, maps))
    return np.array([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def near_rows(i: int, sizes: np.ndarray, maps: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Later rows, by size, that may be linked with row i: of a compatible size, another part, and enough bits in common."""
    end = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")
    near = np.flatnonzero(part[i + 1 : end] != part[i]) + i + 1
    if not len(near):
        return near
    only_i = np.bitwise_count(maps[i] & ~maps[near]).sum(axis=1)
    only_j = np.bitwise_count(maps[near] & ~maps[i]).sum(axis=1)
    bound = np.minimum(sizes[i] - only_i.astype(np.int64), sizes[near] - only_j.astype(np.int64))
    return near[enough(bound, sizes[i], sizes[near], percent)]


def link_sets(sets: list[np.ndarray], parts: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning links between sets of different parts; ``parts`` (changed) gives a known part of each set."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, part = [sets[i] for i in order], sizes[order], parts[order]
    maps = folded([bitmap(s) for s in sets])
    links = []
    for i in range(len(sets) - 1):
        for j in near_rows(i, sizes, maps, part, percent):
            if part[i] != part[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if enough(common, sizes[i], sizes[j], percent):
                    links.append((int(order[i]), int(order[j])))
                    part[part == part[j]] = part[i]
    parts[order] = part
    return links


def unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


LIKELY = "tile long, x int, y int, node long, root long"


def likely_group(percent: int):
    """The rows of a group that have a partner by size and bitmap."""

    def fn(group: pa.Table) -> pa.Table:
        sizes = group["size"].to_numpy()
        order = np.argsort(sizes, kind="stable")
        sizes, part = sizes[order], group["root"].to_numpy()[order]
        alive = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            maps = unpacked(group["bits"])
            maps = folded([maps[k] for k in order])
            for i in range(len(order) - 1):
                near = near_rows(i, sizes, maps, part, percent)
                alive[near] = True
                alive[i] |= len(near) > 0
        return group.select(["tile", "x", "y", "node", "root"]).take(pa.array(order[alive]))

    return fn


def compare_group(percent: int):
    """Links (a, b) of the sets of one group."""

    def fn(group: pa.Table) -> pa.Table:
        nodes, known = group["node"].to_pylist(), group["root"].to_pylist()
        _, parts = np.unique(np.array(known, dtype=np.int64), return_inverse=True)
        before = parts.copy()
        links = link_sets(unpacked(group["shingles"]), parts, percent) if len(nodes) > 1 else []
        # as stars: one member of each part that was joined to others, with the smallest such member
        stars = []
        if links:
            _, first = np.unique(before, return_index=True)
            least: dict[int, int] = {}
            for k in first.tolist():
                least[parts[k]] = min(least.get(parts[k], nodes[k]), nodes[k])
            stars = [(nodes[k], least[parts[k]]) for k in first.tolist() if nodes[k] != least[parts[k]]]
        return pa.table([pa.array([x[k] for x in stars], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

    return fn


REST = "tile long, weight long, node long, root long, apart boolean, keys array<long>, small boolean, light boolean, rest int, shared long, known boolean"


def rest_keys(percent: int):
    """For each member of a block (rows with ``is_head`` are the heads): keys of its rest, how large that is, and what it shares with the heads."""

    def fn(block: pa.Table) -> pa.Table:
        sets, heads = unpacked(block["shingles"]), np.array(block["is_head"].to_pylist(), dtype=bool)
        known = np.unique(np.concatenate([s for s, h in zip(sets, heads) if h]))
        cols = [block[c].to_pylist() for c in ("tile", "weight", "node", "root", "apart")]
        nodes, out = block["node"].to_pylist(), []
        are_heads = {nodes[k] for k in np.flatnonzero(heads)}
        for k in np.flatnonzero(~heads):
            s = sets[k]
            rest, most = np.setdiff1d(s, known, assume_unique=True), allowed(len(s), percent)
            shared = set_key(np.intersect1d(s, known, assume_unique=True))
            small = len(rest) <= most
            out.append((*(c[k] for c in cols), tile_keys(rest, len(s), percent).view(np.int64), small, 2 * len(rest) <= most, len(rest), shared, nodes[k] in are_heads))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in REST.split(", ")]
        return pa.table([pa.array(list(c), type=k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)

    return fn


def document_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit key of the set and its tile keys; a task sends the keys of equal sets once."""

    def build():
        seen: set[tuple[int, int]] = set()

        def fn(ids, hashes, texts):
            cols = ([], [], [], [])
            for doc_id, data in zip(ids, texts):
                s = shingle_set(data, shingle)
                key = (set_key(s), set_key(s ^ MIX))
                new = doc_id is not None and len(s) > 0 and key not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                for col, x in zip(cols, (len(s), *key, tile_keys(s, len(s), percent).view(np.int64) if new else ())):
                    col.append(x)
            return [ids, hashes, *cols]

        return fn

    return map_documents(
        docs, (F.col("doc_id").cast("long"), F.xxhash64("text"), text_bytes()),
        "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>", build,
    )


def fetch(docs: DataFrame, wanted: DataFrame, shingle: int, form: str) -> DataFrame:
    """``sets``: node, shingles, or ``maps``: node, size, bits, of ``wanted(node, id)``, from the texts of these documents only."""

    def build():
        def fn(nodes, texts):
            rows = []
            for node, data in zip(nodes, texts):
                s = shingle_set(data, shingle)
                if set_key(s) == node:  # rows that share a doc_id have other sets too
                    rows.append((node, s.tobytes()) if form == "sets" else (node, len(s), bitmap(s).tobytes()))
            return list(zip(*rows)) if rows else [[]] * (2 if form == "sets" else 3)

        return fn

    texts = only_likely(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", wanted.select("id"))
    texts = texts.join(wanted, "id").withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "node", "hash"])
    return map_documents(texts, ("node", text_bytes()), "node long, shingles binary" if form == "sets" else "node long, size long, bits binary", build)


def in_blocks(tiles: DataFrame, block: int) -> DataFrame:
    """Tiles (tile, node, weight, ...) with ``blocks`` (1 for a small tile) and the member's ``block``; a block weighs about ``block``."""
    parts = tiles.groupBy("tile", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")).agg(F.sum("weight").alias("n"))
    counts = parts.groupBy("tile").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    large = counts.select("tile", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = tiles.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    out = salted.join(large, ["tile", "salt"], "left").drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return out.withColumn("block", F.pmod(F.xxhash64("node", "tile"), F.col("blocks")).cast("int"))


def crossed(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """Rows (tile, x, y, node, root) so that each left member of a tile meets each right one in one group of bounded size."""
    l, r = (in_blocks(df.select("tile", "node", "root", "weight"), block) for df in (left, right))
    n_l, n_r = (df.groupBy("tile").agg(F.max("blocks").alias("n")) for df in (l, r))
    a = l.join(n_r, "tile").select("tile", F.col("block").alias("x"), spread("n", "y"), "node", "root")
    b = r.join(n_l, "tile").select("tile", spread("n", "x"), F.col("block").alias("y"), "node", "root")
    return a.unionByName(b)


def spread(n: str, name: str) -> Column:
    """One row for each number below the column n."""
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)


def with_root(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``root`` of each node, which is its own as long as it has no link."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def class_links(scratch: Scratch, tiles: DataFrame, maps: DataFrame, fetch_sets, percent: int, block: int) -> tuple[DataFrame, bool]:
    """Links (a, b) that span the components of sets, and whether they are (node, root) of all components already.

    ``tiles`` has tile, heads (of the tiles before it), node and weight (one for a usual set), ``maps`` node, size and bits; ``fetch_sets(nodes)`` gives node and shingles.
    """

    def of(rows: DataFrame, what: DataFrame) -> DataFrame:
        """Rows with the sets or bitmaps of their nodes; those of other nodes are not shuffled."""
        return rows.join(only_likely(what, "node", rows.select("node")), "node")

    def likely(name: str, rows: DataFrame) -> DataFrame:
        """Rows (tile, x, y, node, root), each group (tile, x, y) of bounded size, that have a likely partner in their group."""
        rows = rows.select("tile", F.col("x").cast("int"), F.col("y").cast("int"), "node", "root").distinct()
        return scratch.store(name, of(rows, maps).groupBy("tile", "x", "y").applyInArrow(likely_group(percent), LIKELY))

    def compared(name: str, rows: DataFrame, sets: DataFrame) -> DataFrame:
        return scratch.store(name, of(rows, sets).groupBy("tile", "x", "y").applyInArrow(compare_group(percent), "a long, b long"))

    links: list[DataFrame] = []
    settled = lambda: roots is not None and all(x.isEmpty() for x in links[1:])
    roots, sets, level = None, None, 0
    while not (level and tiles.isEmpty()):
        name = lambda x: f"{x}-{level}"  # noqa: B023, E731
        placed = scratch.store(name("placed"), in_blocks(with_root(tiles, roots), block))
        large = placed.filter("blocks > 1")
        # the smallest member of each of some parts of a large tile
        part = F.pmod(F.xxhash64("node", F.lit("head")), F.lit(HEADS)).alias("part")
        first = large.groupBy("tile", "heads", "blocks", part).agg(F.min("node").alias("node"))
        first = first.groupBy("tile", "heads", "blocks").agg(F.collect_list("node").alias("new"))
        first = scratch.store(name("heads"), first)
        in_each = first.select("tile", spread("blocks", "block"), "new").select("tile", "block", F.explode("new").alias("node"))
        one = F.lit(0).alias("x")
        rows = placed.select("tile", one, F.col("block").alias("y"), "node", "root")
        rows = rows.unionByName(with_root(in_each, roots).select("tile", one, F.col("block").alias("y"), "node", "root"))
        alive = likely(name("alive"), rows)
        some = scratch.store("sets-alive", fetch_sets(alive.select("node"))) if sets is None else sets
        links.append(compared(name("links"), alive, some))
        if first.isEmpty():
            break

        if not settled():  # links that came after the last roots
            roots = components(union_all(links))
            large = with_root(large.drop("root"), roots)
        links = [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        share = large.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("n"))
        most = share.groupBy("tile").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n_apart")
        ).filter("n_apart > 0")
        open_ = large.drop("heads").join(most, "tile").withColumn("apart", F.col("root") != F.col("main")).drop("main")
        open_ = scratch.store(name("open"), open_)
        scratch.drop(name("placed"))

        # up to a block of members apart from the rest of their tile: they are compared with all of it
        few = open_.filter(F.col("n_apart") <= block)
        rows = few.select("tile", one, F.col("block").alias("y"), "node", "root")
        rows = rows.unionByName(few.filter("apart").select("tile", one, spread("blocks", "y"), "node", "root"))
        alive = likely(name("few-alive"), rows)
        many = open_.filter(F.col("n_apart") > block)
        if sets is None:
            scratch.drop("sets-alive")
            sets = scratch.store("sets", fetch_sets(alive.select("node").unionByName(many.select("node"))))
        links.append(compared(name("few"), alive, sets))
        if many.isEmpty():
            break

        # more of them: what is left of the members without the shingles of the heads
        heads = first.select("tile", F.array_union("heads", "new").alias("heads"))
        known = many.select("tile", "block").distinct().join(heads, "tile").select("tile", "block", F.explode("heads").alias("node"))
        none = lambda kind: F.lit(None).cast(kind)
        rows = many.select("tile", "weight", "block", "node", "root", "apart", F.lit(False).alias("is_head")).unionByName(
            known.select("*", none("long").alias("weight"), none("long").alias("root"), none("boolean").alias("apart"), F.lit(True).alias("is_head"))
        )
        rests = scratch.store(name("rests"), of(rows, sets).groupBy("tile", "block").applyInArrow(rest_keys(percent), REST))

        # rests that share nothing: the smallest rest stands for those with the same overlap with the heads (heads were compared)
        light = rests.filter("light").groupBy("tile", "shared").agg(F.min(F.struct("rest", "node", "root", "apart", "weight", "known")).alias("s"))
        light = light.select("tile", "s.*").filter("not known").drop("known")
        small = rests.filter("small")
        if not light.join(small.filter("apart").select("tile").distinct(), "tile", "left_semi").isEmpty():
            pairs = crossed(light, small.filter("apart"), block)
            pairs = pairs.unionByName(crossed(light.filter("apart"), small.filter("not apart"), block).withColumn("x", -1 - F.col("x")))
            links.append(compared(name("disjoint"), likely(name("disjoint-alive"), pairs), sets))

        # rests that share a key
        keyed = rests.select("tile", "node", "root", "weight", F.explode("keys").alias("key"))
        meet = keyed.groupBy("tile", "key").agg(F.min("node").alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        found = keyed.join(meet.filter("lo < hi").select("tile", "key", "head"), ["tile", "key"]).select("tile", "head", "node", "weight").distinct()
        next_tile = F.xxhash64("tile", "head", F.lit(level)).alias("tile")
        tiles = scratch.store(name("tiles"), found.join(heads, "tile").select(next_tile, "heads", "node", "weight"))
        scratch.drop(name("open"), name("rests"))
        level += 1
    return union_all(links), settled()


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def linked_sets(docs: DataFrame, shingle: int, percent: int, block: int) -> tuple[Scratch, DataFrame, DataFrame, bool]:
    """The stored rows doc_id, text_hash, n_shingles, set_a, set_b of all documents, and what ``class_links`` returns, by set_a."""
    scratch = Scratch(docs.sparkSession, "near")
    keyed = scratch.store("keyed", document_sets(docs, shingle, percent))
    ids = scratch.store("ids", keyed.drop("keys"))
    keys = keyed.select(F.col("set_a").alias("node"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").drop("last")
    shared = scratch.store("shared", shared)
    # a bare side, so that a hot key can be split in the join
    found = only_likely(keys, "key", shared).join(shared.hint("shuffle_hash"), "key")
    found = found.select(F.col("head").alias("tile"), "node").distinct()
    found = scratch.store("found", found)
    scratch.drop("keyed", "shared")
    classes = ids.filter("n_shingles > 0 and doc_id is not null").groupBy(F.col("set_a").alias("node"), "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"))
    known = scratch.store("known", classes.join(found.select("node").distinct(), "node").select("node", "id", "size"))
    weights = known.groupBy(F.col("node").alias("tile")).agg(F.ceil(F.max("size") / LARGE).alias("weight"))
    tiles = scratch.store("tiles", found.join(weights, "tile").withColumn("heads", F.array().cast("array<long>")))
    known = known.drop("size")
    maps = scratch.store("maps", fetch(docs, known, shingle, "maps"))

    def fetch_sets(nodes: DataFrame) -> DataFrame:
        return fetch(docs, known.join(nodes.distinct(), "node"), shingle, "sets")

    links, settled = class_links(scratch, tiles, maps, fetch_sets, percent, block)
    return scratch, ids, links, settled


def roots_of(links: DataFrame, settled: bool) -> DataFrame:
    """set_a, root of the sets that have links."""
    roots = links.toDF("node", "root") if settled else components(links)
    return roots.withColumnRenamed("node", "set_a")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) of every document."""
    scratch, ids, links, settled = linked_sets(docs, shingle, percent, block)
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    usable = ids.filter(some)
    # rows that share a doc_id are one node: their sets hang together through it
    same = usable.groupBy("doc_id").agg(F.min("set_a").alias("b"), F.max("set_a").alias("last")).filter("b < last").select("doc_id", "b")
    twice = usable.join(same, "doc_id").select(F.col("set_a").alias("a"), "b").distinct()
    twice = scratch.store("twice", twice)
    roots = roots_of(links, settled) if twice.isEmpty() else roots_of(links.unionByName(twice), False)
    least = usable.groupBy("set_a").agg(F.min("doc_id").alias("least"))
    rooted = scratch.store("rooted", least.join(roots, "set_a", "left").withColumn("root", F.coalesce("root", "set_a")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = scratch.store("groups", rooted.join(groups, "root").select("set_a", "component_id"))
    scratch.keep("ids", "groups")
    out = ids.withColumn("set_a", F.when(some, F.col("set_a"))).join(groups, "set_a", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, of which one of each group stays: the one with the smallest doc_id.

    Documents are told apart by doc_id and text, so rows that only share a doc_id are not a group. Of rows that repeat doc_id and
    text one stays. Documents without a word stay, and so do all rows without a doc_id.
    """
    scratch, ids, links, settled = linked_sets(docs, shingle, percent, block)
    roots = roots_of(links, settled)
    known = ids.filter(F.col("doc_id").isNotNull())
    least = known.filter("n_shingles > 0").groupBy("set_a").agg(F.min(F.struct("doc_id", "set_b", "text_hash")).alias("s"))
    rooted = least.join(roots, "set_a", "left").groupBy(F.coalesce("root", "set_a").alias("root")).agg(F.min("s").alias("s"))
    kept = rooted.select(F.col("s.doc_id").alias("kept_id"), F.col("s.text_hash").alias("kept_hash"))
    kept = kept.unionByName(known.filter("n_shingles = 0").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct())
    kept = scratch.store("kept", kept)
    scratch.keep("kept")
    d, k = docs.alias("d"), kept.alias("k")
    same = (F.col("d.doc_id").cast("long") == F.col("k.kept_id")) & (F.xxhash64("d.text") == F.col("k.kept_hash"))
    rows = d.join(k, same, "left_semi")
    hashed = next(f"_hash{n}" for n in range(len(docs.columns) + 1) if f"_hash{n}" not in docs.columns)
    rows = rows.withColumn(hashed, F.xxhash64("text")).dropDuplicates(["doc_id", hashed]).drop(hashed)
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT dx.doc_id AS x, dy.doc_id AS y FROM p JOIN n nx ON p.x = nx.r JOIN n ny ON p.y = ny.r JOIN d dx ON dx.r = p.x JOIN d dy ON dy.r = p.y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(node, seen) AS (SELECT DISTINCT x, x FROM e UNION SELECT t.node, e.y FROM t JOIN e ON e.x = t.seen),
m AS (SELECT node, min(seen) AS component_id FROM t GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.node = d.doc_id"""

"""Merkle manifest of a dataset, with proofs found by pointer jumping.

A row is a leaf: the SHA-256 of its columns, each written with its length. The leaves of a group (a language) stand in order of their
id; every ``FAN`` consecutive digests become one node, level by level, until one is left, the group's subroot. The subroots in order
of their group make the tree on top in the same way, up to the root.

The number of a row in its group comes from a range-partitioned sort: rows are counted within partitions, and only a partition's
first group needs a carry from the partitions before it, so no group meets in one task. Texts are read once; what is sorted and
grouped are digests of 32 bytes.

Proofs: each node begins with the segment of its siblings that leads to its parent. A round of the self-join gives every node the
segment of the node that it points to, behind its own, and that node's pointer, so the distance doubles until all point to the
root. The lowest nodes stand for the leaves of one run each; a leaf's proof is its run's other digests and then its run's
segment. A node that very many point to is copied under as many salts as its height makes necessary.

Handling: a null in any column is written as ``-``; a null group comes first and a null id before all others; ids that repeat in a
group are ordered by their digest, so equal rows give equal trees whatever the order they come in. A null id or text is never
tampered with. An empty table gives no rows. Further columns of any name are not part of a leaf and do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_or_shuffled, table

FAN = 8
#: The name of the tree over the subroots; names of groups begin with another character.
TOP = "^"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def written(value: Column) -> Column:
    """A value as the hash sees it: ``-``, or its number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(written, columns)), 256))


def shown(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def joined(digests: Column) -> Column:
    """An array of digests as one run of bytes."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def parent_of(run: Column) -> Column:
    """The digest of a run of digests, whose hexadecimal text is hashed."""
    return F.unhex(F.sha2(shown(run), 256))


def group_name(group: Column) -> Column:
    """A text that sorts as the group does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit("-"))


def number_rows(df: DataFrame, scratch: Scratch, label: str, group: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``pos``: the place of a row in its group, from 0. ``group`` is a string column without nulls."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group).asc(), *order]
    spread = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = df.columns.index(group)
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("part int, nth long, inner long, opens boolean").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, inner, last, opens = TaskContext.get().partitionId(), 0, 0, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = np.asarray(batch.column(at).to_pylist(), dtype=object)
            change = np.concatenate(([last is not None and names[0] != last], names[1:] != names[:-1])).astype(bool)
            if last is None:
                inner = 0
            # rows since the last change of group; before the first change the count goes on
            starts = np.maximum.accumulate(np.where(change, np.arange(n), -1))
            place = np.where(starts >= 0, np.arange(n) - starts, inner + np.arange(n))
            first = opens & (starts < 0)
            opens, inner, last = bool(first[-1]), int(place[-1]) + 1, names[-1]
            more = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(place.astype(np.int64)), pa.array(first)]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    numbered = scratch.store(label, spread.mapInArrow(count, schema))
    ends = numbered.groupBy("part").agg(
        F.min_by(group, "nth").alias("first"), F.max_by(F.struct(F.col(group).alias("name"), "inner"), "nth").alias("last")
    )
    carry, name, rows = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row per partition of the sort, whatever the number of groups
        before = rows if r["first"] == name else 0
        carry.append((r["part"], before))
        name, rows = r["last"]["name"], r["last"]["inner"] + 1 + (before if r["last"]["name"] == r["first"] else 0)
    carries = F.broadcast(df.sparkSession.createDataFrame(carry, "part int, before long"))
    out = numbered.join(carries, "part").withColumn("pos", F.col("inner") + F.when(F.col("opens"), F.col("before")).otherwise(F.lit(0)))
    return out.select(*df.columns, "pos")


def node_id(level: Column | int, pos: Column, tree: Column) -> Column:
    return F.concat_ws("/", (F.lit(level) if isinstance(level, int) else level).cast("string"), pos.cast("string"), tree)


def grow(nodes: DataFrame, scratch: Scratch, label: str) -> list[DataFrame]:
    """The levels of a forest above ``nodes`` (tree, n, pos, digest; n of the tree), stored: each has also ``run``, the digests below."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < most:
        width *= FAN
        below = levels[-1].filter(F.col("n") > width // FAN)  # trees of which more than one node is left
        runs = below.groupBy("tree", "n", F.floor(F.col("pos") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"))
        run = F.col("kids.digest")
        level = runs.select("tree", "n", F.col("up").alias("pos"), parent_of(joined(run)).alias("digest"), run.alias("run"))
        levels.append(scratch.store(f"{label}-{len(levels)}", level))
    return levels


def segment(run: Column, at: Column) -> Column:
    """array of one struct: the digests beside place ``at`` of a run, as bytes, and how many of them stand to the left."""
    left, right = F.slice(run, F.lit(1), at), F.slice(run, at + 2, F.lit(FAN))
    return F.array(F.struct(at.alias("left"), F.concat(joined(left), joined(right)).alias("siblings")))


SEGMENT = "array<struct<left: int, siblings: binary>>"


def pointers(levels: list[DataFrame], lowest: int) -> DataFrame | None:
    """id, anc (the parent) and seg (the siblings on the way) of every node that has a parent in its tree; ``sub`` is open."""
    out = None
    for k, level in enumerate(levels[1:], lowest + 1):
        kid = level.select("tree", "n", F.col("pos").alias("up"), "run", F.posexplode("run").alias("at", "digest"))
        rows = kid.select(
            node_id(k - 1, F.col("up") * FAN + F.col("at"), F.col("tree")).alias("id"), node_id(k, F.col("up"), F.col("tree")).alias("anc"),
            segment(F.col("run"), F.col("at")).cast(SEGMENT).alias("seg"), F.lit(None).cast("binary").alias("sub"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def jump(nodes: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """The nodes with segments that reach the root, by doubling; ``nodes`` (id, anc, seg, sub) has every node but the root."""
    now, done, rounds = scratch.store("jump-0", nodes), None, 0
    while True:
        there = now.filter(F.col("anc") == root)
        done = there if done is None else done.unionByName(there)
        away = now.filter(F.col("anc") != root)
        if away.isEmpty():
            return done
        # a node at this distance is pointed to from at most FAN ** (2 ** rounds) others; beyond FAN ** 2 they are salted
        salts = FAN ** min(4, max(0, 2**rounds - 2))
        salt = F.pmod(F.xxhash64("id"), F.lit(salts))
        # a target is pointed to by open nodes, but may itself be done already
        every = (away.unionByName(done)).select(F.col("id").alias("at"), F.col("anc").alias("next"), F.col("seg").alias("more"), F.col("sub").alias("above"))
        if salts > 1:  # few nodes are left to point to, and only these are copied
            aims = away.select(F.col("anc").alias("aim")).distinct()
            every = every.join(aims, F.col("at") == F.col("aim"), "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        else:
            every = every.withColumn("salt", F.lit(0))
        pair = away.withColumn("key", salt.cast("int")).join(every, (F.col("anc") == F.col("at")) & (F.col("key") == F.col("salt")))
        moved = pair.select("id", F.col("next").alias("anc"), F.concat("seg", "more").alias("seg"), F.coalesce("sub", "above").alias("sub"))
        rounds += 1
        now = scratch.store(f"jump-{rounds}", moved)


def fold(start: Column, path: Column) -> Column:
    """The digest at the end of a path, from a digest at its beginning; hexadecimal."""
    part = lambda s, at, n: F.substr(shown(s.siblings), at, n)
    step = lambda d, s: F.sha2(F.concat(part(s, F.lit(1), s.left * 64), d, part(s, s.left * 64 + 1, F.lit(64 * FAN))), 256)
    return F.aggregate(path, start, step)


def manifest(rows: DataFrame, group: str, key: str, columns: Sequence[str], changed: Column) -> DataFrame:
    """Per row: the key, its leaf, subroot, root, the hash of its proof, the root folded from ``changed`` (a digest, null where the leaf
    stands) and whether that is the root. ``columns`` are what a leaf is made of."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "merkle")
    tree = group_name(F.col(group))
    hashed = rows.select(tree.alias("tree"), F.col(key).alias("key"), digest(*(F.col(c) for c in columns)).alias("leaf"), changed.alias("changed"))
    hashed = scratch.store("hashed", hashed)
    leaves = number_rows(hashed, scratch, "leaves", "tree", [F.col("key").asc_nulls_first(), F.col("leaf").asc()])
    counts = scratch.store("counts", leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    n_groups = counts.count()
    counts = small_or_shuffled(counts)  # in a shuffle of many groups Spark splits the large parts
    runs = leaves.groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "leaf", "changed"))).alias("kids"))
    whole = parent_of(joined(F.col("kids.leaf")))
    # a leaf alone is its subroot
    runs = runs.join(counts, "tree").select("tree", "pos", F.ceil(F.col("n") / FAN).alias("n"), (F.col("n") == 1).alias("alone"), "kids", F.when(F.col("n") == 1, F.col("kids")[0].leaf).otherwise(whole).alias("digest"))
    runs = scratch.store("runs", runs)
    scratch.drop("hashed")
    levels = grow(runs.select("tree", "n", "pos", "digest"), scratch, "level")
    tops, width = None, 1
    for k, level in enumerate(levels, 1):
        top = level.filter((F.col("n") <= width) & (F.col("n") > width // FAN)).select(F.col("tree").alias("name"), F.lit(k).alias("level"), "digest")
        tops, width = top if tops is None else tops.unionByName(top), width * FAN
    tops = number_rows(tops.withColumn("tree", F.lit(TOP)), scratch, "subroots", "tree", [F.col("name").asc()])
    subroots = scratch.store("top-0", tops.withColumn("n", F.lit(n_groups).cast("long")))
    upper = grow(subroots.select("tree", "n", "pos", "digest"), scratch, "top")
    last = upper[-1].select("pos", "digest").head(2)
    if not last:
        return spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, {RESULT}")
    # nodes of the tree on top begin at level 0, where each is also the top node of its group
    top_id = node_id(F.col("level"), F.lit(0), F.col("name"))
    links = [x for x in (pointers(levels, 1), pointers(upper, 0)) if x is not None]
    bridge = subroots.select(top_id.alias("id"), node_id(0, F.col("pos"), F.col("tree")).alias("anc"), F.array().cast(SEGMENT).alias("seg"), F.col("digest").alias("sub"))
    nodes = bridge
    for x in links:
        nodes = nodes.unionByName(x)
    root_id = f"{len(upper) - 1}/0/{TOP}"
    root = shown(F.lit(bytes(last[0]["digest"])))
    scratch.drop("leaves", "subroots", "counts")
    paths = jump(nodes, root_id, scratch)
    found = runs.withColumn("id", node_id(1, F.col("pos"), F.col("tree"))).join(paths.select("id", "seg", "sub"), "id")
    leaf = found.select("alone", "seg", "sub", F.col("kids.leaf").alias("run"), F.posexplode("kids").alias("at", "kid"))
    path = F.when(F.col("alone"), F.col("seg")).otherwise(F.concat(segment(F.col("run"), F.col("at")).cast(SEGMENT), F.col("seg")))
    leaf = leaf.select(F.col("kid.key").alias(key), "kid.leaf", "kid.changed", "sub", path.alias("path"))
    siblings = F.aggregate("path", F.lit(b""), lambda a, s: F.concat(a, s.siblings))
    out = leaf.select(
        F.col(key), shown(F.col("leaf")).alias("leaf"), shown(F.col("sub")).alias("subroot"), root.alias("root"),
        F.sha2(shown(siblings), 256).alias("proof_sha256"), fold(shown(F.coalesce("changed", "leaf")), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; the text of every third one (by a hash of its id) is lower-cased after the proofs were made."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = digest(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS))
    return manifest(docs, "lang", "doc_id", COLUMNS, F.when(tampered, lower))


def _oracle() -> str:
    """The same tree by grouping level after level; a tree with one node left passes it on as it is."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in COLUMNS) + ")"
    depth, depth_top = 8, 5
    ctes = [
        "codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, 3988292384 * (c & 1)))) AS t)",
        "sums AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents d, codes)",
        f"leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT doc_id, coalesce(':' || lang, '-') AS grp, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM sums))",
        "g0 AS (SELECT grp, n, pos, leaf AS d FROM leaves)",
    ]
    for name, n_levels in (("g", depth), ("u", depth_top)):
        if name == "u":
            ctes.append(f"u0 AS (SELECT 'top' AS grp, count(*) OVER () AS n, row_number() OVER (ORDER BY grp) - 1 AS pos, d, grp AS was FROM g{depth})")
        for k in range(n_levels):
            ctes.append(f"r{name}{k} AS (SELECT grp, n, pos // 8 AS pos, list(d ORDER BY pos) AS run FROM {name}{k} GROUP BY grp, n, pos // 8)")
            ctes.append(f"{name}{k + 1} AS (SELECT grp, n, pos, CASE WHEN n > {8**k} THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM r{name}{k})")
    ctes.append(f"s0 AS (SELECT l.*, u.pos AS upos, u.n AS un, g.d AS subroot, top.d AS root, '' AS proof, coalesce(changed, leaf) AS fold FROM leaves l JOIN u0 u ON u.was = l.grp JOIN g{depth} g ON g.grp = l.grp, u{depth_top} top)")
    at = 0
    for name, n_levels, pos, n, own in (("g", depth, "pos", "n", "s.grp"), ("u", depth_top, "upos", "un", "'top'")):
        for k in range(n_levels):
            q = f"(s.{pos} // {8**k})"
            left, right = f"array_to_string(run[1:{q} % 8], '')", f"array_to_string(run[{q} % 8 + 2:], '')"
            more = f"s.{n} > {8**k}"
            ctes.append(
                f"s{at + 1} AS (SELECT s.* EXCLUDE (proof, fold), CASE WHEN {more} THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN {more} THEN sha256({left} || fold || {right}) ELSE fold END AS fold"
                f" FROM s{at} s JOIN r{name}{k} r ON r.grp = {own} AND r.pos = {q} // 8)"
            )
            at += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM s{at}"


ORACLE_SQL = _oracle()

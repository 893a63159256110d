"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lanternscan.llm import merkle
from lanternscan.llm.common import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, row)))


def climb(level, at):
    """Root of a tree, and for place ``at`` the (left, right) siblings of each level."""
    path = []
    while len(level) > 1:
        first = at // 8 * 8
        path.append((level[first:at], level[at + 1 : first + 8]))
        level, at = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)], at // 8
    return level[0], path


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subs = [climb([leaf_of(r) for r in groups[n]], 0)[0] for n in names]
    out = []
    for k, n in enumerate(names):
        leaves = [leaf_of(r) for r in groups[n]]
        root, above = climb(subs, k)
        for at, row in enumerate(groups[n]):
            path = climb(leaves, at)[1] + above
            now = leaves[at]
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                now = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            proof = sha("".join(x for left, right in path for x in left + right))
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            out.append((row[0], leaves[at], subs[k], root, proof, now, now == root))
    return sorted(out, key=str)


def prove(spark, rows, tmp_path, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in ("tree", "pos", "key", "leaf", "id", "n")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_one_deep_group_and_many_small_ones(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice(["a", None, "é"]), "deep", r.choice([None, k]), r.choice([None, "", "Ab C", "x" * 5000, "ÀB"])) for k in range(700)]
    rows += [(r.randrange(10**12), "s", f"lang{k % 90}", k, "Text") for k in range(150)]
    rows += [(k, None, None, None, None) for k in range(9)] + [(5, "s", "", 1, "one"), (None, "s", "en", 1, "One"), (None, "s", "en", 1, "Two")]
    rows += [(77, "s", "same", 1, "Same")] * 20 + [(78, "s", "same", 1, "A"), (78, "s", "same", 1, "B")]
    r.shuffle(rows)
    got = prove(spark, rows, tmp_path)
    assert got == brute(rows)
    assert 0 < sum(not g[-1] for g in got) < len(got) and len({g[3] for g in got}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(n)]
    assert prove(spark, rows, tmp_path, extra=False) == brute(rows)


def test_places_within_groups(spark):
    """Groups that end, begin and go on across partitions."""
    r = random.Random(1)
    rows = [(g, r.random()) for g, n in (("a", 1), ("b", 500), ("c", 2), ("d", 90), ("e", 1)) for _ in range(n)]
    r.shuffle(rows)
    df = merkle.number_rows(spark.createDataFrame(rows, "g string, x double"), Scratch(spark, "test"), "t", "g", [F.col("x").asc()])
    want = {}
    for g, x in sorted(rows):
        want[g, x] = sum(h == g for h, _ in want)
    assert {(q.g, q.x): q.pos for q in df.collect()} == want

"""Files in blocks give what whole contents give, wherever blocks end; a growing file gives its lines once."""

import random

import pytest

from lanternscan.operators.blocks import block_facts, block_lines, hidden_lines, scan_blocks
from lanternscan.operators.buffers import STEP, scan_buffers
from lanternscan.plans.ruleset import RuleSet
from lanternscan.rules.model import Allowlist, Required, Rule
from lanternscan.sources.blocks import BlockSource

RULES = RuleSet((Rule(id="tok", regex=r"tok_[a-z0-9]{6,}", keywords=("tok_",)), Rule(id="two", regex=r"begin\n+end", keywords=("begin",))), (Allowlist(paths=("^no/",)),))


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(BlockSource)
    return spark


@pytest.mark.parametrize("windows", [1, 3, 2048])
def test_blocks_equal_whole_files(source, tmp_path, windows):
    r = random.Random(windows)
    parts = ["tok_abcdef ", "tok_" + "z" * 40, "é" * 50, "\n", "\r\n", "\n\n", "x" * 3000, " scan:allow ", "begin\nend", "begin\n\n\nend", "word " * 100]
    files = {f"d{k % 3}/f{k}.txt": "".join(r.choice(parts) for _ in range(r.choice([1, 20, 80]))) for k in range(9)}
    files |= {"no/x.txt": "tok_abcdef", "empty.txt": "", "long.txt": "tok_aaaaaa" + "y" * (5 * STEP) + "tok_bbbbbb" + "y" * 9000 + "\ntok_cccccc\n", "hid.txt": "tok_aaaaaa" + "y" * (4 * STEP) + "scan:allow" + "y" * 9999 + "tok_bbbbbb\ntok_cccccc",
              "edge.txt": "y" * (STEP - 5) + "scan:allow" + "y" * 8000 + " tok_aaaaaa\n" + "y" * (2 * STEP) + "\ntok_dddddd", ".hidden": "tok_hhhhhh"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    blocks = source.read.format("file_blocks").option("windows", windows).load(tmp_path.as_uri())
    whole = source.createDataFrame([(n, bytearray(t.encode())) for n, t in files.items() if n[0] != "."], "path string, content binary")
    columns = ["rule_id", "file", "start_line", "start_column", "end_line", "end_column", "match", "fingerprint", "place"]
    got, want = (sorted(map(tuple, df.select(columns).collect())) for df in (scan_blocks(blocks, RULES), scan_buffers(whole, RULES)))
    facts = source.read.format("file_blocks").option("windows", windows).option("facts", "scan:allow").load(tmp_path.as_uri())
    assert sorted(map(tuple, scan_blocks(blocks, RULES, facts=facts).select(columns).collect())) == want
    assert got == want and {g[1] for g in got} >= {"long.txt", "hid.txt"} and len(got) > 20
    if windows == 1:
        assert blocks.rdd.getNumPartitions() > 50  # one file is many tasks
        at = {(x.path, x.block): x for x in block_lines(block_facts(blocks)).collect()}
        assert at["long.txt", 5].line0 == 1 and at["long.txt", 5].start0 == 0
        assert ("hid.txt", 1) in {tuple(x) for x in hidden_lines(block_lines(block_facts(blocks))).collect()}


def test_what_needs_whole_contents(source, tmp_path):
    (tmp_path / "a").write_text("x")
    blocks = source.read.format("file_blocks").load(str(tmp_path / "a"))
    assert [(x.path, x.size) for x in blocks.collect()] == [("a", 1)]
    for rs in (RuleSet((Rule(id="r", regex="x", required=(Required("q", "y", 1),)),)), RuleSet(RULES.rules, (Allowlist(regexes=("x",), regex_target="line"),))):
        with pytest.raises(ValueError):
            scan_blocks(blocks, rs)


def test_members_of_one_zip_are_many_tasks(source, tmp_path):
    """A zip of a thousand members: read by their ranges, by every task, and as the archive's own reader gives them."""
    import zipfile

    from lanternscan.sources.archives import archive_lines, zip_lines, zip_members

    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(1000):
            z.writestr(zipfile.ZipInfo(f"d{k % 7}/é{k}.txt"), f"line {k}\r\n" + "x" * (k % 50) + "\n", (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[k % 3])
        z.writestr("../out.txt", "no")
        z.writestr("empty.txt", "")
    (tmp_path / "bad.zip").write_bytes(b"PK not a zip")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "big.zip").read_bytes()[:-5000])
    df = source.createDataFrame([(n, (tmp_path / n).as_uri()) for n in ("big.zip", "bad.zip", "cut.zip")], "path string, real string")
    assert zip_members(df).count() == 1001
    whole = source.createDataFrame([("big.zip", bytearray((tmp_path / "big.zip").read_bytes()))], "path string, content binary")
    lines = zip_lines(df, tasks=8)
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, archive_lines(whole).collect())) and lines.count() == 2000
    from pyspark.sql import functions as F

    assert lines.select(F.spark_partition_id()).distinct().count() == 8


def test_lines_of_one_file_are_many_tasks(source, tmp_path):
    from lanternscan.sources.files import read_lines

    r = random.Random(3)
    lines = [f"{k} " + "é" * r.choice([0, 1, 40, 5000]) + r.choice(["", "\r"]) for k in range(400)]
    for end in ("\n", ""):
        (tmp_path / "pipe.txt").write_bytes(("\n".join(lines) + end).encode())
        got = read_lines(source, str(tmp_path / "pipe.txt"), "p", windows=1).collect()
        assert sorted((x.line_no, x.line) for x in got) == [(k + 1, x.removesuffix("\r")) for k, x in enumerate(lines)] and {x.path for x in got} == {"p"}
    (tmp_path / "none").write_bytes(b"")
    assert read_lines(source, str(tmp_path / "none"), "p").count() == 0


def test_growing_file(source, tmp_path):
    """Batches hold whole lines, each once, cut into ranges of many tasks; the open last line waits for its end."""
    log, out, state = tmp_path / "in" / "app.log", tmp_path / "out", tmp_path / "state"
    log.parent.mkdir()
    r = random.Random(1)
    lines = [f"{k} " + "w" * r.choice([1, 50, 7000]) for k in range(200)]

    def run():
        stream = source.readStream.format("file_blocks").option("windows", 1).load(log.parent.as_uri())
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = sorted((x.base, bytes(x.data)) for x in source.read.parquet(str(out)).collect())
        return b"".join(d for _, d in rows)

    whole = "".join(x + "\n" for x in lines).encode()
    cut = whole.index(b"\n150 ") + 9  # in the middle of a line
    log.write_bytes(whole[:cut])
    assert run() == whole[: whole.rindex(b"\n", 0, cut) + 1]
    with log.open("ab") as f:
        f.write(whole[cut:])
    assert run() == whole

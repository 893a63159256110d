"""Token files: an exact round trip against the tokenizer, and views without copies."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternscan.llm import token_files as tf

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.default_tokenizer())


ODD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n\n\nb", "a \t b\r\n c", "it's we'll I'D 's  's", "x\x1c y\x85 z", "a\xa0 b", "a \xa0  b", "\u3000 x \u2009 y",
    "<|endoftext|> hi<|endoftext|>", "日本語 テキスト", "é́ ñ", "½ ² x²y", "12 345,6", "....!!! ?", "x" * 3000, "y " * 5000, "- " * 10 + " " * 50 + "end",
]


def test_chunks_equal_the_tokenizer(tokenizer, monkeypatch):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "a", "Bc", "'s", "'", "12", ".", "é", "日", "<|endoftext|>"]
    texts = [x for x in ODD if x is not None] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (tf.LONG_CHUNK, 3):  # all in one go, and pretoken by pretoken
        monkeypatch.setattr(tf, "LONG_CHUNK", limit)
        encoder = tf.ChunkEncoder(tf.default_tokenizer())
        for t, ids in zip(texts, want):
            assert np.frombuffer(b"".join(encoder.encode(t.encode())), dtype=encoder.dtype).tolist() == ids, repr(t)


@pytest.mark.parametrize("length,rows,parts", [(2048, 256, 5), (16, 3, 4), (10, 2, 1)])
def test_round_trip(spark, tokenizer, tmp_path, length, rows, parts):
    r = random.Random(length)
    texts = [*ODD, *("word " * r.randint(0, 300) for _ in range(40))]
    ids = [*r.sample(range(-50, 10**9), len(texts) - 6), None, None, 7, 7, 7, 8]
    made = list(zip(ids, texts)) + [(7, "same"), (7, "same")]
    df = spark.createDataFrame(made, SCHEMA).withColumns({c: F.lit("clash") for c in ("data", "tie", "part", "start")})
    manifest = tf.write_tokens(df, str(tmp_path / "out"), length=length, batch_rows=rows, parts=parts)
    got = sorted((tuple(x) for x in tf.read_documents(manifest).collect()), key=lambda x: x[1])
    enc = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sorted((str(x[0]), x[2], x[3]) for x in got) == sorted((str(k), len(enc(t)), crc(enc(t))) for k, t in made)
    assert [x[0] for x in got] == sorted((x[0] for x in got), key=lambda k: (k is not None, k or 0))
    at = 0
    for x in got:
        assert x[1] == at
        at += x[2]
    # the sequences, with their masks, hold all ids of a file end to end
    for m in manifest.collect():
        f = tf.SequenceFile(m.ids_path)
        assert len(f) == m.n_sequences == -(-m.n_ids // length)
        assert all(f.reader.get_batch(k).num_rows == rows for k in range(f.n_batches - 1))
        own, ids = [x for x in got if x[4] == m.part], []
        for k in r.sample(range(len(f)), len(f)):
            s, mask = f.sequence(k), np.unpackbits(f.mask(k), bitorder="little")[:length]
            assert len(s) == length and not s.flags.owndata and mask.sum() == min(length, m.n_ids - k * length) and (np.diff(mask.astype(int)) <= 0).all()
            ids.append((k, s[mask == 1].tolist()))
        flat = [i for _, s in sorted(ids) for i in s]
        at = 0
        for x in own:
            assert crc(flat[at : at + x[2]]) == x[3]
            at += x[2]
        assert at == len(flat) == m.n_ids


def test_views_are_not_copied(tmp_path):
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as sink:
        w = tf.SequenceWriter(sink, np.dtype("<u2"), 2048, 64, 2)
        for k in range(300):
            w.append(np.full(5000, k, dtype="<u2").tobytes())
        w.close()
    f, before = tf.SequenceFile(f"file://{tmp_path}/f.arrow"), pa.total_allocated_bytes()
    views = [f.sequence(k) for k in range(len(f))] + [f.mask(k) for k in range(len(f))]
    assert pa.total_allocated_bytes() - before < 100_000 and len(views) == 2 * -(-300 * 5000 // 2048)
    assert sum(int(v.sum(dtype=np.int64)) for v in views[: len(f) - 1]) + int(views[len(f) - 1][: 300 * 5000 % 2048].sum(dtype=np.int64)) == 5000 * sum(range(300))


def test_lost_attempts_and_empty_tables(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "part-000000-left.ids.arrow").write_bytes(b"of a lost task")
    manifest = tf.write_tokens(spark.createDataFrame([(1, "a")], SCHEMA), str(folder))
    assert len(list(folder.glob("*.arrow"))) == 2 == 2 * manifest.count()
    none = tf.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert none.count() == 0 == tf.read_documents(none).count()

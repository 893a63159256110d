"""Texts of some megabytes through the operators that look at words, windows and letters."""

import random

from lanternscan.llm import decontamination, language_id, suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**9):x}" for _ in range(n)]


def test_decontamination_of_a_long_text_and_repeated_benchmark_rows(spark):
    """The window stands at the very end; benchmark rows that repeat fall into several blocks."""
    item, other = words(1, 30), words(2, 12)
    long = words(3, 400_000) + item[5:20]
    docs = spark.createDataFrame([(1, " ".join(long), "en"), (2, " ".join(words(4, 200_000)), "en"), (3, "x " * 10 + " ".join(other), "en")], SCHEMA)
    bench = spark.createDataFrame([(7, " ".join(item))] * 40 + [(8, " ".join(other))] * 3 + [(9, None), (10, "")], "item_id long, text string")
    for block_bytes in (600, 8 << 20):
        rows = {r.doc_id: r for r in decontamination.digest(decontamination.find_hits(docs, bench, block_bytes=block_bytes)).collect()}
        assert [(rows[k].n_words, rows[k].n_hit, rows[k].n_items, rows[k].contaminated) for k in (1, 2, 3)] == [(400_015, 15, 40, True), (200_000, 0, 0, False), (22, 12, 3, True)]


def test_repeats_of_long_texts(spark):
    """Two long texts share sixty words, one at its beginning and one at its end, and one of them repeats a passage of its own."""
    shared, own = words(5, 60), words(6, 55)
    a = words(7, 150_000) + shared
    b = shared + words(8, 100_000) + own + words(9, 1000) + own
    docs = spark.createDataFrame([(1, " ".join(a), "en"), (2, " ".join(b), "en"), (3, " ".join(words(10, 100)), "en")], SCHEMA)
    rows = {r.doc_id: r for r in suffix_dedup.find_repeats(docs).collect()}
    spans = lambda r: list(zip(r.starts, r.ends))
    assert spans(rows[1]) == [(150_000, 150_060)] and spans(rows[2]) == [(0, 60), (100_060, 100_115), (101_115, 101_170)] and not rows[3].n_repeated
    assert (rows[1].n_cut, rows[2].n_cut) == (0, 60 + 55)


def test_language_of_long_texts(spark):
    r = random.Random(2)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ß"]}
    rows = [(k, make(kinds[lang], 40), lang) for k in range(40) for lang in [("aa", "bb")[k % 2]]]
    profiles = language_id.learn_profiles(spark.createDataFrame(rows, SCHEMA))
    long = [(100, make(kinds["aa"], 300_000), None), (101, make(kinds["bb"], 200_000) + " 1²½ " * 100_000, None), (102, "½² 12 !? " * 200_000, None)]
    got = {x.doc_id: x.lang_pred for x in language_id.identify(spark.createDataFrame(long, SCHEMA), profiles).collect()}
    assert got == {100: "aa", 101: "bb", 102: "und"}

"""The corpus pipeline against its operators, stage by stage, and its registration."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lanternscan.llm import decontamination, ngram_jaccard, packing, queries

from .test_operators import check_packing, near_copies, toxic_corpus


def write_tables(spark, folder):
    texts, marks = toxic_corpus(200)
    r = random.Random(1)
    bench = [" ".join(f"b{r.randrange(900)}" for _ in range(20)) for _ in range(3)]
    extra = [*near_copies(6, 80, 4), "start " + bench[0] + " end", "mail a.b@c.example.com now and then, twice a day or more often", None, ""]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([*texts, *extra])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [t for _, t, *_ in docs], marks


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    texts, marks = write_tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept[-1], d).write.parquet(f"{d}/{name}")
        kept.append(spark.read.parquet(f"{d}/{name}"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    toxic = {k for k, y in enumerate(marks) if y}
    assert len(toxic - ids[1]) >= 0.95 * len(toxic) and ids[0] - ids[1] <= toxic
    near = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicates(kept[1]).collect()}
    assert ids[2] == {k for k, c in near.items() if k == c} and len(ids[2] & set(range(200, 206))) < 6
    hits = decontamination.find_hits(kept[2], spark.read.parquet(f"{d}/benchmark.parquet"))
    assert ids[2] - ids[3] == {r.doc_id for r in hits.filter(F.size("starts") > 0).collect()} == {206}
    after = {r.doc_id: r for r in kept[4].collect()}
    assert "a.b@c.example.com" not in after[207].text and after[207].n_chars == len(after[207].text) and ids[4] == ids[3]
    order = sorted(after)
    rows = packing.packed_documents(kept[4].withColumn("doc_id", F.array_position(F.lit(order), F.col("doc_id")) - 1)).collect()
    check_packing(rows, [after[k].text for k in order], packing.CAPACITY)
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == ids[4] and sum(r.length for r in out) == sum(r.length for r in rows)


def test_near_duplicates_between_thresholds(spark):
    """A copy of 100 words with two changed ones: 0.81 of five-word shingles, but 0.885 of three-word ones; with three changed ones it stays."""
    base = [f"w{k}" for k in range(100)]
    two = [f"e{k}" if k in (30, 60) else w for k, w in enumerate(base)]
    three = [f"f{k}" if k in (20, 50, 80) else w for k, w in enumerate(base)]
    rows = [(k, " ".join(w), "en", "s", None) for k, w in enumerate([base, two, three])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2}
    assert {r.doc_id for r in ngram_jaccard.keep_one_per_group(docs).collect()} == {0, 1, 2}


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows and clashing columns pass through every stage."""
    base = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("n_words", "node", "size", "rep", "tile", "kept_id", "_hash0", "_changed0", "root", "count", "near", "pii_entities")
    rows = [(1, "mail a.b@c.example.com now"), (1, "mail a.b@c.example.com now"), (1, "another text with the same id " * 5), (None, None), (None, "kept"), (None, "kept"), (2, ""), (3, None)]
    labels = "doc_id long, quality int, toxic int"
    bench = spark.createDataFrame([(None, None)], "item_id long, text string")
    for name, data in (("odd", [(k, t, None, None, None) for k, t in rows]), ("empty", [])):
        d = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(data, base).withColumns({c: F.lit("mine") for c in clash})
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{d}/labels.parquet")
        bench.limit(1 if data else 0).write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            fn(spark, now, d).write.parquet(f"{d}/{stage}")
            now = spark.read.parquet(f"{d}/{stage}")
            assert now.columns == docs.columns and not now.filter(" or ".join(f"{c} <> 'mine'" for c in clash)).count()
        left = sorted((str(r.doc_id), str(r.text)[:7]) for r in now.collect())
        want = [("1", "another"), ("1", left[1][1] if len(left) > 1 else ""), ("2", ""), ("3", "None"), ("None", "None"), ("None", "kept"), ("None", "kept")]
        assert left == (want if data else [])
        assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == ({1, 2, 3, None} if data else set())


def test_registration():
    names = queries.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(names)

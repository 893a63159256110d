"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 3, over letters with word ends) of a language or document in
order of rank; ties go to the smaller n-gram code. The distance of a document to a language sums, over the document's
profile, how far each n-gram is out of place; an n-gram that the language lacks costs the profile size. The smallest
distance wins, ties go to the first language in alphabetical order.

Profiles are fitted on at most about ``TRAIN_DOCS`` documents of each language, chosen by a hash of their ids, in the training
fold; n-grams are counted in Spark. A letter is a character of the Unicode category L. Prediction covers every whole text in one narrow pass.

``und`` with score 0 is returned for null texts, texts without a letter, and when nothing could be learned. Repeated rows get
equal results; a null doc_id belongs to the training fold only if it has a fold, so it is never learned from.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_documents, small_or_shuffled, table, text_bytes

PROFILE = 300
TRAIN_DOCS = 2_000
FOLDS, HELD_OUT_FOLD = 4, 2


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether a code point is a letter, for all code points; made once a worker."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % folds


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text, ascending, with their counts. A code holds up to three code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = np.concatenate(([False], letter_table()[points], [False]))
    if not letter.any():
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    # every run of other characters becomes one space, and one stands at either end
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    points = np.where(letter, np.concatenate(([0], points, [0])), 32)[keep].astype(np.uint64)
    space = points == 32
    grams = [points[~space]]
    code = points
    for n in (2, 3):
        code = (code[:-1] << np.uint64(21)) | points[n - 1 :]
        # a space may stand at an end only
        grams.append(code[~space[1:-1]] if n == 3 else code[~(space[:-1] & space[1:])])
    return np.unique(np.concatenate(grams), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The codes of a profile, most frequent first; equal counts by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Language profiles as one sorted code table with the rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.uint64))
        self.ranks = np.full((len(self.codes), len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[name], dtype=np.uint64)), k] = np.arange(len(profiles[name]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, profile), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == profile)[:, None], self.ranks[at], -1)
        away = np.abs(ranks - np.arange(len(profile))[:, None])
        return np.where(ranks < 0, self.size, np.minimum(away, self.size)).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        profile = top(codes, counts, self.size)
        d = self.distances(profile)
        best = int(np.argmin(d))
        return self.names[best], float(1 - d[best] / (self.size * len(profile)))


def learn_profiles(docs: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Count n-grams per language in Spark; only the top ``size`` of each language reach the driver."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rates = usable.groupBy(F.col("lang").alias("_lang")).agg((F.lit(1e6) * train_docs / F.count(F.lit(1))).alias("_rate"))
    # a rare language keeps all its documents
    usable = usable.select("doc_id", "lang", "text").join(small_or_shuffled(rates), F.col("lang") == F.col("_lang"))
    usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("profiles")), F.lit(1_000_000)) < F.col("_rate"))

    def build():
        def fn(langs, texts):
            sums: dict[str, dict[int, int]] = {}
            for lang, data in zip(langs, texts):
                have = sums.setdefault(lang, {})
                for code, count in zip(*map(np.ndarray.tolist, ngram_counts(data.decode("utf-8", "replace")))):
                    have[code] = have.get(code, 0) + count
            rows = [(lang, code, count) for lang, have in sums.items() for code, count in have.items()]
            return list(zip(*rows)) if rows else [[], [], []]

        return fn

    counted = map_documents(usable, ("lang", text_bytes()), "lang string, code long, n long", build)
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the best ``size`` of each language by aggregation, so that no language needs one task
    part = F.pmod(F.hash("code"), F.lit(64))
    order = F.struct((-F.col("n")).alias("m"), F.col("code"))
    some = totals.groupBy("lang", part.alias("part")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, size).alias("best"))
    best = some.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, size).alias("best"))
    return Profiles({r["lang"]: [x["code"] for x in r["best"]] for r in best.collect()}, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def build():
        predict = shared.value.predict

        def fn(ids, texts):
            got = [predict(None if x is None else x.decode("utf-8", "replace")) for x in texts]
            return [ids, [g[0] for g in got], [g[1] for g in got]]

        return fn

    return map_documents(docs, (F.col("doc_id").cast("long"), text_bytes()), "doc_id long, lang_pred string, score double", build)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(fold(FOLDS) != HELD_OUT_FOLD))
    held = F.coalesce(fold(FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")

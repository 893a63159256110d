"""Toxicity: a weighted finite-state pattern grammar over clauses.

Four transducers read the words of a text and write them again with marks; a word that no lexicon knows is the symbol OTHER:

* the lexical one maps a word to insult (with a weight), threat, target, negation, reporting word, quotation mark or clause end;
* the negation one marks insults and threats up to three words after a negation;
* the reported-speech one marks those after a reporting word of the clause or within quotation marks;
* the target one marks those up to four words after a person, and, read from right to left, those before one.

The machines over symbols are tables of states and arcs with weights. ``compose`` joins those that read from left to right into one;
the right-to-left machine reads what it wrote. A marked insult or threat is an arc of its clause (ARCS) with the product
of the weights on its way; the weights of a document's matched clauses per arc are the only input of a logistic score.

Insult stems and their weights are learned from labelled documents: word prefixes whose presence goes with the label by a
likelihood-ratio test, counted in Spark over a sample of at most about ``TRAIN_DOCS`` documents for each label, in which near copies count
once. A small seed list is always part of the lexicon. The logistic weights are fitted on the same sample.

Null and empty texts match no clause and get the score of such a text. Labels that are null are left out; of several labels
of a document the largest counts. Without labels the seed lexicon and fixed weights are used. Repeated rows get equal scores.
Texts are read in one pass, whatever their length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_documents, map_documents, table, text_bytes, token_hashes, window_hashes

TRAIN_DOCS = 15_000
FOLDS, HELD_OUT_FOLD = 5, 0
LEXICON = 1_000
MIN_G2, MIN_PRECISION = 30.0, 0.5
PREFIXES = (4, 5, 6, 7, 8)

# Seed words of the grammar in four languages.
SEED_INSULTS = ["idiot", "moron", "stupid", "imbecile", "scumbag", "dumbass", "asshole", "arschloch", "dummkopf", "connard", "abruti", "gilipollas", "pendejo"]
THREATS = ["kill", "murder", "strangle", "stab", "shoot", "töten", "umbringen", "erschießen", "tuer", "égorger", "étrangler", "matar", "apuñalar"]
TARGETS = ["you", "your", "you're", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "euch", "sie", "tu", "toi", "vous", "ils", "elles", "tú", "te", "usted", "ustedes", "ellos"]
NEGATIONS = ["not", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "niemals", "pas", "jamais", "nunca", "jamás", "tampoco"]
REPORTS = ["said", "says", "wrote", "writes", "called", "quoted", "claimed", "sagte", "schrieb", "nannte", "dit", "disait", "écrit", "appelé", "dijo", "dice", "escribió", "llamó"]

ARCS = ("insult", "targeted", "negated", "reported", "threat", "threat_marked")
FEATURES = (*ARCS, "matched_clauses", "best_clause")
#: Used when there are no labels: bias, then one weight per feature.
PRIOR = [-3.0, 1.0, 1.5, 0.2, 0.4, 1.0, 0.2, 0.5, 0.5]

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]|[\"“”«»„]")
CLAUSE_ENDS = frozenset(".!?;:\n")
QUOTES = frozenset('"“”«»„')


OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = "other", "insult", "threat", "target", "negation", "report", "quote", "end"
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END)
#: Marks that the machines put on an insult or a threat, with the weight of the arc that puts it.
MARKS = {"n": 0.3, "r": 0.3, "t": 1.0}


@dataclass
class Transducer:
    """States 0, 1, ... (0 is the first); ``arcs[state][symbol]`` is (written symbol, weight, next state)."""

    arcs: list[dict[str, tuple[str, float, int]]]

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        out, state = [], 0
        for x in symbols:
            written, weight, state = self.arcs[state][x]
            out.append((written, weight))
        return out


def marked(symbol: str, mark: str) -> str:
    """An insult or threat with one more mark; ``insult+nt`` is an insult with the marks n and t."""
    name, _, marks = symbol.partition("+")
    return f"{name}+{''.join(sorted({*marks, mark}))}"


def alphabet(marks: str) -> list[str]:
    """The classes, and insults and threats with any of the marks."""
    sets = [""]
    for m in marks:
        sets += [x + m for x in sets]
    return [*CLASSES, *(f"{name}+{''.join(sorted(m))}" for name in (INSULT, THREAT) for m in sets if m)]


def machine(n_states: int, symbols: list[str], mark: str, marking, move) -> Transducer:
    """A machine that marks insults and threats in the states where ``marking`` holds; ``move(state, class)`` is the next state."""
    arcs = []
    for q in range(n_states):
        row = {}
        for x in symbols:
            name = x.partition("+")[0]
            hit = name in (INSULT, THREAT) and marking(q)
            row[x] = (marked(x, mark) if hit else x, MARKS[mark] if hit else 1.0, move(q, name))
        arcs.append(row)
    return Transducer(arcs)


def within(scope: int, opener: str, symbols: list[str], mark: str) -> Transducer:
    """Marks up to ``scope`` words after an opener in the same clause; a state is the number of words that are left."""

    def move(q: int, name: str) -> int:
        return scope if name == opener else 0 if name == END else q if name == QUOTE else max(0, q - 1)

    return machine(scope + 1, symbols, mark, lambda q: q > 0, move)


def reported(symbols: list[str], mark: str) -> Transducer:
    """Marks after a reporting word until the clause ends, and between quotation marks; state bits: reported, quoted."""

    def move(q: int, name: str) -> int:
        return q | 1 if name == REPORT else q & 2 if name == END else q ^ 2 if name == QUOTE else q

    return machine(4, symbols, mark, lambda q: q > 0, move)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what ``second`` does to the output of ``first``; weights multiply. Only reachable pairs of states are made."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for p, q in todo:
        row = {}
        for x, (mid, w1, p2) in first.arcs[p].items():
            out, w2, q2 = second.arcs[q][mid]
            if (p2, q2) not in number:
                number[p2, q2] = len(todo)
                todo.append((p2, q2))
            row[x] = (out, w1 * w2, number[p2, q2])
        arcs.append(row)
    return Transducer(arcs)


@dataclass
class Grammar:
    """The lexical machine and the composed ones."""

    stems: dict[str, float]  # prefix -> weight; a whole word ends with a space
    threats: list[str] = field(default_factory=lambda: THREATS)
    negation_scope: int = 3
    target_scope: int = 4

    def __post_init__(self):
        import ahocorasick

        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.classes = {w: THREAT for w in self.threats}
        for name, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (QUOTE, QUOTES), (END, CLAUSE_ENDS)):
            self.classes |= dict.fromkeys(words, name)
        self.automaton = ahocorasick.Automaton()
        for key in {s.rstrip(" ") for s in self.stems} | set(self.threats):
            self.automaton.add_word(key, len(key))
        self.automaton.make_automaton()
        self.forward = compose(
            compose(within(self.negation_scope, NEGATION, alphabet(""), "n"), reported(alphabet("n"), "r")),
            within(self.target_scope, TARGET, alphabet("nr"), "t"),
        )
        self.backward = within(self.target_scope, TARGET, alphabet("nrt"), "t")

    def insult(self, word: str) -> float:
        """The weight of the longest stem that the word begins with."""
        whole = word + " "
        for n in self.sizes:
            w = self.stems.get(whole[:n])
            if w is not None:
                return w
        return 0.0

    def may_match(self, text: str) -> bool:
        """Whether any stem or threat begins a word; without one no clause can match."""
        for end, size in self.automaton.iter(text):
            if end == size - 1 or not text[end - size].isalpha():
                return True
        return False

    def lexical(self, words: list[str]) -> tuple[list[str], list[float]]:
        """The symbol and weight of each word."""
        symbols, weights = [], []
        for word in words:
            weight = self.insult(word)
            symbols.append(INSULT if weight else self.classes.get(word, OTHER))
            weights.append(weight or 1.0)
        return symbols, weights

    def clauses(self, text: str) -> list[list[tuple[str, float, float]]]:
        """(symbol with marks, lexical weight, weight on the way) of the insults and threats of each clause that has any."""
        symbols, weights = self.lexical(WORD.findall(text))
        ahead = self.forward.run(symbols)
        back = self.backward.run([x for x, _ in reversed(ahead)])[::-1]
        out, now = [], []
        for symbol, weight, (_, w1), (final, w2) in zip(symbols, weights, ahead, back):
            if symbol in (INSULT, THREAT):
                now.append((final, weight, w1 * w2))
            elif symbol == END and now:
                out.append(now)
                now = []
        return [*out, now] if now else out

    def features(self, text: str | None) -> list[float]:
        """log(1 + sum of weights) per arc, log(1 + matched clauses), and the best clause."""
        text = (text or "").lower()
        sums = dict.fromkeys(ARCS, 0.0)
        matched, best = 0, 0.0
        if text and self.may_match(text):
            for clause in self.clauses(text):
                matched += 1
                total = 0.0
                for symbol, weight, factor in clause:
                    name, _, marks = symbol.partition("+")
                    if name == THREAT:
                        weight = 1.0 + ("t" in marks)
                    sums[arc_of(name, marks)] += weight
                    total += weight * factor
                best = max(best, total)
        return [*(math.log1p(sums[a]) for a in ARCS), math.log1p(matched), best / (1 + best)]


def arc_of(name: str, marks: str) -> str:
    if name == THREAT:
        return "threat_marked" if "n" in marks or "r" in marks else "threat"
    return "negated" if "n" in marks else "reported" if "r" in marks else "targeted" if "t" in marks else "insult"


@dataclass
class Model:
    grammar: Grammar
    weights: list[float]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.grammar.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """doc_id, text, toxic of labelled documents, of each label a bounded sample; of near copies the one with the smallest id."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = F.lit(1_000_000)
    for label, n in counts.items():  # a rare label keeps all that it has
        rate = F.when(F.col("toxic") == label, F.lit(min(1_000_000, int(1e6 * train_docs / n)))).otherwise(rate)
    known = known.filter(F.pmod(F.xxhash64("label_id", F.lit("toxicity")), F.lit(1_000_000)) < rate)

    def build():
        def fn(ids, texts, toxic):
            keys = []
            for data in texts:
                words = data.split()
                h = window_hashes(token_hashes(words), min(6, max(1, len(words))))
                keys.append(int(h.min() >> np.uint64(1)) if len(h) else 0)
            return [ids, [x.decode("utf-8", "replace") for x in texts], toxic, keys]

        return fn

    # the sampled labels are at most about twice train_docs rows, a documented bound
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    keyed = map_documents(found, ("label_id", text_bytes(), "toxic"), "doc_id long, text string, toxic int, near long", build)
    first = keyed.groupBy("near", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("s"))
    return first.select("s.doc_id", "s.text", "toxic")


def stem_counts(train: DataFrame) -> DataFrame:
    """For word prefixes and whole words: toxic and other documents that hold them."""

    def build():
        def fn(texts, toxic):
            counts: dict[str, list[int]] = {}
            for data, y in zip(texts, toxic):
                stems = set()
                for word in set(re.findall(r"[^\W\d_]{4,}", data.decode("utf-8", "replace").lower())):
                    stems.update(word[:n] for n in PREFIXES if n <= len(word))
                    stems.add(word[:40] + " ")
                for s in stems:
                    counts.setdefault(s, [0, 0])[y > 0] += 1
            return [list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]]

        return fn

    got = map_documents(train, (text_bytes(), "toxic"), "stem string, pos long, neg long", build)
    return got.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 3 and pos > neg")


def choose_stems(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int, most: int = LEXICON) -> dict[str, float]:
    """Stems by a likelihood-ratio test; of nested ones the longest that loses few toxic documents."""
    rate = n_pos / max(1, n_pos + n_neg)
    good: dict[str, tuple[float, int]] = {}
    for stem, pos, neg in rows:
        n, p = pos + neg, pos / (pos + neg)
        g2 = 2 * sum(k * math.log(k / (n * r)) for k, r in ((pos, rate), (neg, 1 - rate)) if k and r > 0)
        if p >= MIN_PRECISION and g2 >= MIN_G2:
            good[stem] = (math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)), pos)
    kept: dict[str, float] = {}
    for stem in sorted(good, key=len):
        above = next((stem[:n] for n in range(len(stem) - 1, 3, -1) if stem[:n] in kept), None)
        if above is None or good[stem][1] >= 0.9 * good[above][1]:
            if above is not None:
                del kept[above]
            kept[stem] = good[stem][0]
    top = sorted(kept, key=lambda s: (-good[s][1] * kept[s], s))[:most]
    return {s: round(max(0.5, kept[s]), 6) for s in top}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Newton steps for ridge logistic regression; the bias is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(shrink)
        step = np.linalg.solve(hessian, a.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from the training fold; what reaches the driver is bounded by train_docs and LEXICON."""
    train = training_rows(docs, labels, train_docs).persist()
    try:
        counts = {r["toxic"] > 0: r["count"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
        n_pos, n_neg = counts.get(True, 0), counts.get(False, 0)
        stems: dict[str, float] = {}
        if n_pos and n_neg:
            rows = stem_counts(train).orderBy(F.desc("pos"), "neg", "stem").limit(20 * LEXICON).collect()
            stems = choose_stems([tuple(r) for r in rows], n_pos, n_neg)
        prior = min(stems.values(), default=2.0)
        for seed in SEED_INSULTS:
            if not any(seed.startswith(s.rstrip(" ")) for s in stems):
                stems[seed] = prior
        grammar = Grammar(stems)
        if not (n_pos and n_neg):
            return Model(grammar, PRIOR)
        names = ", ".join(f"{f} double" for f in FEATURES)

        def build():
            mine = Grammar(stems)

            def fn(texts, toxic):
                rows = [mine.features(x.decode("utf-8", "replace")) for x in texts]
                return [toxic, *(list(zip(*rows)) if rows else [[]] * len(FEATURES))]

            return fn

        data = map_documents(train, (text_bytes(), "toxic"), f"toxic int, {names}", build).toPandas()
        return Model(grammar, fit_logistic(data[list(FEATURES)].to_numpy(), (data["toxic"] > 0).to_numpy(dtype=float)))
    finally:
        train.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document; one narrow pass."""
    stems, weights = model.grammar.stems, model.weights

    def build():
        mine = Model(Grammar(stems), weights)

        def fn(ids, texts):
            return [ids, [mine.score(None if x is None else x.decode("utf-8", "replace")) for x in texts]]

        return fn

    out = map_documents(docs, (F.col("doc_id").cast("long"), text_bytes()), "doc_id long, score double", build)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    stems, weights = model.grammar.stems, model.weights

    def build():
        mine = Model(Grammar(stems), weights)
        return lambda texts: [mine.score(None if x is None else x.decode("utf-8", "replace")) < threshold for x in texts]

    return filter_documents(docs, build)


def learn_from_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows outside the held-out fold."""
    train = fold(FOLDS) != HELD_OUT_FOLD
    return learn(docs.filter(train), labels.filter(train))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_from_fold(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")

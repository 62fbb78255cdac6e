"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Three steps. (1) A lexical transducer turns words into symbols: insult, slur, threat, target, negation,
reported speech, clause end, other. Insult and slur stems are learned: word beginnings that occur in toxic
training texts far beyond chance, counted once per text and once per pair of neighbouring words, so that
copies of one text prove nothing. Stems that clean texts hardly know are insults, the others slurs. The
other symbols come from fixed word lists. (2) Small machines (words since a negation, reported speech within
the clause, words since a target) are composed into one transducer by the product construction. It reads the
clauses and gives each insult, slur or threat a path class: negated or not, reported or not, with a target or
not; a clause has the class of its weightiest match and counts once. (3) Path weights are the toxic share of training texts with that class, drawn to a prior. The sums of
path weights per kind, and the slurs' sum per word (ambiguous stems also occur by chance, in proportion to
length), go through a logistic curve fitted on the training texts.

Training reads at most ``per_class`` texts with label 1 and three times as many with label 0 (the smallest id
hashes): the documented bound. Scoring is one narrow pass over whole texts, without shuffle.

Defined cases: null or empty text scores what texts without a match have; rows without label, with
null id or label are not learned from; several labels of a text count as toxic if any is; no labelled row
leaves the fixed lists and priors; equal texts score alike; columns ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import common as C
from .langid import fold

PER_CLASS = 4000
THRESHOLD = 0.3
#: Words between a negation or target and the insult it belongs to.
REACH = 3

OTHER, INSULT, SLUR, THREAT, TARGET, NEGATION, REPORT, STOP = range(8)
SYMBOLS = 8
KINDS = (INSULT, SLUR, THREAT)

#: Word lists of the grammar in English, German, French and Spanish. Fixed values.
INSULTS = ("idiot", "moron", "scum", "loser", "bastard", "trottel", "abschaum", "crétin", "ordure", "imbécile", "basura", "imbécil")
THREATS = ("kill", "murder", "hurt", "strangle", "umbringen", "töten", "verprügeln", "tuer", "frapper", "étrangler", "matar", "golpear")
TARGETS = ("you", "your", "yourself", "u", "he", "she", "they", "them", "du", "dich", "dir", "euch", "ihr", "sie", "tu", "toi", "vous", "ils",
           "tú", "usted", "ustedes", "vosotros", "ellos")
NEGATIONS = ("not", "never", "no", "nor", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún")
REPORTS = ("said", "says", "say", "called", "wrote", "quoted", "reported", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

#: Prior weight of a path class and how many texts it counts for.
PRIOR = (0.6, 0.3, 0.3)
PRIOR_TEXTS = 2.0
#: Intercept and slopes of the logistic curve where nothing can be fitted: insults, slurs, slurs per 1000 words, threats.
CURVE = (-4.0, 6.0, 0.5, 1.0, 3.0)
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n,]")


# ---------------------------------------------------------------- machines

@dataclass(frozen=True)
class Machine:
    """A small automaton: ``step[state][symbol]`` is the next state, ``says[state]`` whether it vouches for a match now."""

    step: tuple[tuple[int, ...], ...]
    says: tuple[bool, ...]


def since(symbol: int, reach: int = REACH) -> Machine:
    """Vouches for up to ``reach`` words after ``symbol`` in the same clause."""
    rows = []
    for left in range(reach + 1):
        rows.append(tuple(reach if s == symbol else 0 if s == STOP else max(left - 1, 0) for s in range(SYMBOLS)))
    return Machine(tuple(rows), tuple(left > 0 for left in range(reach + 1)))


def within(symbol: int) -> Machine:
    """Vouches from ``symbol`` to the end of the clause."""
    return Machine(tuple(tuple(1 if s == symbol else 0 if s == STOP else on for s in range(SYMBOLS)) for on in (0, 1)), (False, True))


@dataclass(frozen=True)
class Transducer:
    step: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]  # path class given on an insult, slur or threat, else -1


def compose(*machines: Machine) -> Transducer:
    """Product of the machines; on an insult, slur or threat it gives class = kind, then one bit per machine."""
    states = list(product(*(range(len(m.step)) for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    step = tuple(tuple(number[tuple(m.step[a][x] for m, a in zip(machines, s))] for x in range(SYMBOLS)) for s in states)
    bits = 1 << len(machines)

    def given(state, symbol):
        if symbol not in KINDS:
            return -1
        vouched = sum(m.says[a] << k for k, (m, a) in enumerate(zip(machines, state)))
        return bits * KINDS.index(symbol) + vouched

    return Transducer(step, tuple(tuple(given(s, x) for x in range(SYMBOLS)) for s in states))


GRAMMAR = compose(since(NEGATION), within(REPORT), since(TARGET))
CLASSES = 24


def class_prior(k: int) -> float:
    base = PRIOR[k // 8]
    if k & 1 or k & 2:  # negated or reported
        base *= 0.5
    if k & 4:  # with a target
        base = 1 - (1 - base) / 2
    return base


#: Place of each class by its prior weight, the weightiest first: the class that stands for a clause with several matches.
RANK = [sorted(range(CLASSES), key=lambda k: (-class_prior(k), k)).index(k) for k in range(CLASSES)]


# ---------------------------------------------------------------- model

@dataclass
class Model:
    insults: list[str] = field(default_factory=list)  # "abc": any word that begins so, "abc$": that word
    slurs: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [class_prior(k) for k in range(CLASSES)])
    curve: list[float] = field(default_factory=lambda: list(CURVE))

    @staticmethod
    def begins(stems: list[str]) -> re.Pattern:
        parts = [re.escape(s[:-1]) + r"\Z" if s.endswith("$") else re.escape(s) for s in sorted(stems)]
        return re.compile("|".join(parts) or r"(?!)")

    @cached_property
    def words(self) -> tuple[dict[str, int], re.Pattern, re.Pattern, re.Pattern]:
        lists = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT))
        any_of = {s.rstrip("$") for s in (*self.insults, *self.slurs)} | set(INSULTS) | set(THREATS)
        return ({w: s for words, s in lists for w in words}, self.begins(self.insults), self.begins(self.slurs),
                re.compile("|".join(re.escape(w) for w in sorted(any_of))))

    def symbol(self, word: str) -> int:
        fixed, insult, slur, _ = self.words
        if word in ".!?;:\n,":
            return STOP
        if insult.match(word):
            return INSULT
        return fixed.get(word, SLUR if slur.match(word) else OTHER)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def read(self, text: str) -> tuple[int, list[int]]:
        """Words of a whole text and its matched clauses per path class; (0, zeros) where no stem or threat occurs at all.

        A clause counts once, with the weightiest class of its matches.
        """
        counts = [0] * CLASSES
        text = text.lower()
        if not self.words[3].search(text):
            return 0, counts
        state, known, n, best = 0, {}, 0, -1
        for found in WORD.finditer(text):
            word = found.group()
            symbol = known.get(word)
            if symbol is None:
                symbol = known[word] = self.symbol(word)
            n += symbol != STOP
            given = GRAMMAR.out[state][symbol]
            if given >= 0 and (best < 0 or RANK[given] < RANK[best]):
                best = given
            if symbol == STOP and best >= 0:
                counts[best] += 1
                best = -1
            state = GRAMMAR.step[state][symbol]
        if best >= 0:
            counts[best] += 1
        return n, counts

    def features(self, n: int, counts: list[int]) -> list[float]:
        total = [sum(counts[k] * self.weights[k] for k in range(8 * kind, 8 * kind + 8)) for kind in range(3)]
        return [1.0, math.log1p(total[0]), math.log1p(total[1]), math.log1p(1000 * total[1] / (n + 20)), math.log1p(total[2])]

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.curve, self.features(*self.read(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_curve(rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> list[float]:
    """Weighted logistic regression by damped Newton steps, drawn to CURVE."""
    prior = np.array(CURVE)
    w = prior.copy()

    def loss(w):
        z = rows @ w
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + ridge / 2 * ((w - prior) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (weight * (p - toxic)) + ridge * (w - prior)
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        step, t, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w.tolist()


def log_tail(hits: int, misses: int, share: float) -> float:
    """log P(at least ``hits`` of hits + misses) when each is one with probability ``share``."""
    n = hits + misses
    top = math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(misses + 1) + hits * math.log(share) + misses * math.log1p(-share)
    ratio = misses / (hits + 1) * share / (1 - share)
    return min(0.0, top - math.log1p(-ratio)) if ratio < 1 else 0.0


#: A stem is an insult if clean texts have it at most once for so many toxic ones (at equal numbers of words), a slur from the second on.
PURE, MIXED = 200, 6


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Insult and slur stems: the most significant beginnings, none of which begins another; of equals the longest."""
    if not toxic or not clean:
        return [], []
    share = toxic / (toxic + clean)
    level = -math.log(max(len(counts), 10)) - 5
    tails = {p: log_tail(t, c, share) for p, (t, c) in counts.items() if t * clean > MIXED * c * toxic}
    insults: list[str] = []
    slurs: list[str] = []
    above: set[str] = set()  # beginnings of chosen stems
    chosen: set[str] = set()
    for p in sorted((p for p in tails if tails[p] < level), key=lambda p: (round(tails[p], 6), -len(p), p)):
        if p in above or any(p[:k] in chosen for k in range(1, len(p))):
            continue
        chosen.add(p)
        above.update(p[:k] for k in range(1, len(p)))
        t, c = counts[p]
        (insults if t * clean > PURE * c * toxic else slurs).append(p)
    return sorted(insults), sorted(slurs)


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of the rows that may be learned from: folds other than 2."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 2))
            .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic")))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(id, toxic, text) of the bounded sample: folds other than 2, fixed by id hash."""
    marked = labelled(labels, id_col, label_col)
    chosen = C.hash_sample(marked, "toxic", "id", F.when(F.col("toxic") == 1, F.lit(per_class)).otherwise(3 * per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])  # at most 4 x per_class ids


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, t, c): texts with a word that begins so, once per word and neighbours, toxic and clean."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    near = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.xxhash64(
        F.get("words", i - 1), F.get("words", i + 1)).alias("near")))
    seen = (rows.select("id", "toxic", words.alias("words")).select("id", "toxic", F.explode(near).alias("x"))
            .groupBy("id", "toxic", "x.word").agg(F.min("x.near").alias("near"))
            .select("toxic", "word", "near").distinct()
            .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    # the word itself with its end, whatever its length, and beginnings of 4 and more letters
    open_ends = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.char_length("word"))), lambda k: F.substring("word", F.lit(1), k))
    ends = F.concat(F.when(F.char_length("word") >= 4, open_ends).otherwise(F.array().cast("array<string>")), F.array(F.concat("word", F.lit("$"))))
    return (seen.select(F.explode(F.array_distinct(ends)).alias("stem"), "t", "c")
            .groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    spark = docs.sparkSession
    C.prepare(spark)
    rows = C.stage(training_rows(docs, labels, id_col, text_col, label_col, per_class), "toxic_rows")
    counts = C.stage(stem_counts(rows), "stems")
    total = counts.where(F.col("stem").endswith("$")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    toxic, clean = int(total["t"] or 0), int(total["c"] or 0)
    # bounded by the training sample's vocabulary; stems that could not pass are left where they are
    close = counts.where((F.col("t") >= 3) & (F.col("t") * F.lit(clean) > MIXED * F.col("c") * F.lit(toxic))).toPandas()
    model = Model(*choose_stems({r.stem: (int(r.t), int(r.c)) for r in close.itertuples()}, toxic, clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.read(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(
                [c for _, c in got], pa.list_(pa.int64()))], ["toxic", "n", "classes"])

    # at most 4 x per_class rows of 26 numbers
    seen = rows.select("toxic", "text").mapInArrow(run, "toxic int, n long, classes array<long>").toPandas()
    C.unstage(counts)
    C.unstage(rows)
    if seen["toxic"].nunique() < 2:
        return model
    # the classes were sampled at different rates: weigh each back to its share of all labelled texts
    all_of = {r["toxic"]: r["n"] for r in labelled(labels, id_col, label_col).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    had = seen["toxic"].value_counts()
    is_toxic = seen["toxic"].to_numpy().astype(float)
    weight = np.array([max(all_of.get(t, 0), had[t]) / had[t] for t in seen["toxic"]])
    classes = np.array(seen["classes"].tolist())
    for k in range(CLASSES):
        t, c = (weight * is_toxic * (classes[:, k] > 0)).sum(), (weight * (1 - is_toxic) * (classes[:, k] > 0)).sum()
        model.weights[k] = float((t + PRIOR_TEXTS * class_prior(k)) / (t + c + PRIOR_TEXTS))
    features = np.array([model.features(n, c) for n, c in zip(seen["n"], classes.tolist())])
    model.curve = fit_curve(features, is_toxic, weight)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    spark = df.sparkSession
    C.prepare(spark)
    base = df.drop("score", "predicted")
    at = base.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # stems of the bounded sample and 29 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            got = [grammar.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())],
                                             [*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op8_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs, C.read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_grammar_toxicity": op8_grammar_toxicity}

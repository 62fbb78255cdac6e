"""Operator 7: mixing sources to target weights with soft membership.

A softmax regression, fitted on the labelled table, gives every document a posterior over domains. Then
nonnegative rates r_d are fitted so that the expected domain token totals, sum_d r_d tokens_d p_dk, match
targets: least squares in the metric of the domains' Gram matrix, by projected gradient. In that metric a
gradient step moves r_d by p_d . g with one vector g per round, so a document's rate follows from its own
posterior and the list of vectors: a round is one distributed sum of as many numbers as there are domains,
and no rate is ever kept or shuffled.

A document's copies are floor(r) or one more, by a hash of its id, so that their expectation is the rate.

With ``thin`` only documents judged to be of that domain may lose copies: the rates of all others, those whose
posterior gives it at most one half, are clipped at one copy instead of zero (still a projection, so the rounds
go to the least-squares rates under that bound). ``Fit.gap`` tells what is left to the targets.

Training takes at most ``per_domain`` labelled documents of each domain (the smallest id hashes): the
documented bound; their fixed-width features come to the driver. Totals and rates cover all documents.

Defined cases: null or empty text has 0 tokens and still a posterior and a rate; rows with null id, or
labels that are null, are not learned from; several labels of one id: the smallest domain name counts; a
target domain that no document can belong to is left out of the fit; targets that cannot all be met leave
the least-squares rates; without labelled rows there is one domain and all rates are equal; an empty table
gives an empty result; equal texts get equal rates; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import common as C

PER_DOMAIN = 1000
SLOTS = 4096
SHAPES = 8
#: Weights of the expected tokens by domain: a labelled text of low quality is ``poor``, any other its language.
TARGETS = {"en": 0.45, "de": 0.18, "fr": 0.18, "es": 0.16, "poor": 0.03}
ROUNDS, CLOSE = 60, 1e-5
#: Columns that the operator adds or replaces.
ADDED = ("tokens", "posterior", "rate", "copies")


def featurise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x (SLOTS + SHAPES)) features and the words of each whole text: hashed words, log scaled, unit length; shares of character kinds."""
    n = len(offsets) - 1
    words, owner = C.word_hashes(data, offsets)
    tokens = np.bincount(owner, minlength=n)
    bag = np.bincount(owner * SLOTS + (words >> C.U64(52)).astype(np.int64), minlength=n * SLOTS).reshape(n, SLOTS)
    bag = np.log1p(bag).astype(np.float32)
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-6)
    kind = np.zeros(256, np.int64)  # other, upper, lower, digit, space, punctuation, beyond ASCII
    for k, (lo, hi) in enumerate(((65, 90), (97, 122), (48, 57), (9, 13), (33, 47), (128, 255)), start=1):
        kind[lo:hi + 1] = k
    kind[32], kind[58:65], kind[91:97], kind[123:127] = 4, 5, 5, 5
    shapes = np.zeros((n, SHAPES), np.float32)
    for i in range(n):
        seen = np.bincount(kind[data[offsets[i]:offsets[i + 1]]], minlength=7)
        shapes[i, :7] = seen / max(1, offsets[i + 1] - offsets[i])
    cuts = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        if tokens[i]:
            shapes[i, 7] = len(np.unique(words[cuts[i]:cuts[i + 1]])) / tokens[i]
    return np.concatenate([bag, 3 * shapes], axis=1), tokens


def _sparse(row: np.ndarray) -> bytes:
    """Places (16 bits) and then values (half floats) of a row's non-zero features."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f2").tobytes()


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        z = rows @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_softmax(rows: np.ndarray, labels: list[str], shares: dict[str, float], ridge: float = 1e-3, rounds: int = 400) -> Model:
    """Accelerated full-batch gradient descent on a balanced sample; the bias then returns to the domains' true shares."""
    domains = sorted(set(labels))
    which = np.array([domains.index(x) for x in labels])
    one = np.eye(len(domains), dtype=np.float32)[which]
    weight = (1.0 / np.bincount(which)[which]).astype(np.float32)[:, None] / len(domains)
    model = Model(domains, np.zeros((rows.shape[1], len(domains)), np.float32), np.zeros(len(domains), np.float32))
    w, last = model.weights, model.weights
    rate = np.float32(1.0)
    for t in range(rounds):
        model.weights = w + np.float32(t / (t + 3)) * (w - last)
        slope = rows.T @ (weight * (model.posterior(rows) - one)) + np.float32(ridge) * model.weights
        w, last = model.weights - rate * slope, w
    model.weights = w
    model.bias = np.log(np.array([max(shares.get(d, 0.0), 1e-6) * len(domains) for d in domains])).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
        per_domain: int = PER_DOMAIN) -> Model:
    """Domain classifier from a labelled table (id_col, domain_col)."""
    C.prepare(docs.sparkSession)
    known = (labels.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("domain")))
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row per domain
    if not counts:
        return Model(["all"], np.zeros((SLOTS + SHAPES, 1), np.float32), np.zeros(1, np.float32))
    chosen = C.hash_sample(known, "domain", "id", F.lit(per_domain))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an id may be repeated over much of the table: one text of each leaves the executors
    rows = rows.groupBy("id", "domain").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in C.text_groups(batch.column(2)):
                found, _ = featurise(data, offs)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), pa.array(
                    [_sparse(r) for r in found], pa.binary())], ["id", "domain", "x"])

    # per_domain rows of at most SLOTS + SHAPES numbers per domain
    got = rows.mapInArrow(run, "id string, domain string, x binary").toPandas().sort_values(["domain", "id", "x"])
    if got.empty:
        return Model(["all"], np.zeros((SLOTS + SHAPES, 1), np.float32), np.zeros(1, np.float32))
    x = np.zeros((len(got), SLOTS + SHAPES), np.float32)
    for row, packed in zip(x, got["x"]):
        half = len(packed) // 2
        row[np.frombuffer(packed[:half], "<u2")] = np.frombuffer(packed[half:], "<f2")
    total = sum(counts.values())
    return fit_softmax(x, got["domain"].tolist(), {k: n / total for k, n in counts.items()})


def with_posterior(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``tokens`` (words of the whole text) and ``posterior`` (array in the order of model.domains); a narrow pass."""
    spark = df.sparkSession
    C.prepare(spark)
    base = df.drop("tokens", "posterior")
    at = base.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # (SLOTS + SHAPES) x domains numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            tokens, posterior = [], []
            for lo, hi, data, offs in C.text_groups(batch.column(at)):
                for a in range(0, hi - lo, 512):
                    b = min(a + 512, hi - lo)
                    rows, n = featurise(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                    tokens.extend(n.tolist())
                    posterior.extend(known.posterior(rows).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array(posterior, pa.list_(pa.float64()))],
                                             [*batch.schema.names, "tokens", "posterior"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))]))


@dataclass
class Fit:
    start: float
    steps: list[list[float]]
    totals: list[float]
    wanted: list[float]
    #: Place of the domain whose documents alone may have less than one copy; None: all may.
    thin: int | None = None

    def gap(self) -> list[float]:
        """Expected tokens over (or under) the target of each domain."""
        return [a - b for a, b in zip(self.totals, self.wanted)]

    def rate(self, posterior: Column) -> Column:
        """The rate as a column: start, then one clipped step per vector."""
        least = F.lit(0.0) if self.thin is None else F.when(F.get(posterior, F.lit(self.thin)) > 0.5, 0.0).otherwise(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in self.steps]) if self.steps else F.array().cast("array<array<double>>")
        return F.aggregate(steps, F.greatest(least, F.lit(float(self.start))), lambda r, s: F.greatest(least, r - F.aggregate(
            F.zip_with(posterior, s, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)))


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, rounds: int = ROUNDS, close: float = CLOSE,
              thin: str | None = None) -> Fit:
    """Rates for rows (tokens, posterior). ``targets``: weight per domain; ``budget``: expected tokens in all (default: as many as there are).

    ``thin``: the domain whose documents alone may get less than one copy. The default budget is then the smallest
    at which no other domain's target lies below the tokens it has.
    """
    k = len(domains)
    p = lambda i: F.col("posterior")[i]
    first = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), *[
        F.coalesce(F.sum(F.col("tokens") * p(i) * p(j)), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    tokens = float(first["n"])
    held = None if thin is None else domains.index(thin) if thin in domains else k  # k: no document is of that domain
    if not tokens:
        return Fit(1.0, [], [0.0] * k, [0.0] * k, held)
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    weight = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(k, 1.0 / k)
    if budget is None:
        budget = tokens
        if thin is not None:
            budget = max([tokens, *[t / w for t, w, d in zip(gram.sum(axis=1), weight, domains) if w > 0 and d != thin]])
    budget = float(budget)
    wanted = budget * weight
    inverse = np.linalg.pinv(gram / tokens, rcond=1e-10) / tokens
    out = Fit(budget / tokens, [], [], wanted.tolist(), held)
    for _ in range(rounds + 1):
        got = rows.withColumn("rate", out.rate(F.col("posterior"))).agg(*[F.sum(F.col("rate") * F.col("tokens") * p(i)).alias(f"t{i}") for i in range(k)]).first()
        before, out.totals = out.totals, [float(got[f"t{i}"]) for i in range(k)]
        gap = np.array(out.totals) - wanted
        if np.abs(gap).max() <= close * budget or len(out.steps) == rounds:
            break
        if held is not None and before and max(abs(a - b) for a, b in zip(before, out.totals)) <= close * budget:
            break  # the bound leaves a gap that further rounds do not change
        out.steps.append((inverse @ gap).tolist())
    return out


def with_copies(df: DataFrame, model: Model, fitted: Fit, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """``df`` with tokens, posterior, ``rate`` and ``copies``."""
    rated = with_posterior(df, model, text_col).withColumn("rate", fitted.rate(F.col("posterior")))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) / F.lit(2.0 ** 53)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def label_domains(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled table (id, domain): ``poor`` for quality 0, the language for quality 1."""
    known = labels.select(id_col, "quality").join(docs.select(id_col, "lang"), id_col)
    return known.select(id_col, F.when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, F.col("lang")).alias("domain"))


def natural_totals(rows: DataFrame, domains: list[str]) -> dict[str, float]:
    """Expected tokens of each domain as they are: one number per domain."""
    got = rows.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(domains))]).first()
    return {d: float(got[f"t{i}"]) for i, d in enumerate(domains)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None,
        factors: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
        thin: str | None = None) -> tuple[DataFrame, Model, Fit]:
    """Documents with their copies, classifier and fit. The rates are fitted on a staged table without texts.

    Either ``targets`` (weights) with ``budget`` (expected tokens), or ``factors``: each domain's target is its
    present expected total times its factor (``""``: of domains not named). ``thin`` as in :func:`fit_rates`.
    """
    model = fit(docs, labels, id_col, text_col)
    narrow = C.stage(with_posterior(docs.select(text_col), model, text_col).select("tokens", "posterior"), "posterior")
    if factors is not None:
        targets = {d: n * factors.get(d, factors.get("", 1.0)) for d, n in natural_totals(narrow, model.domains).items()}
        budget = sum(targets.values())
    fitted = fit_rates(narrow, model.domains, targets or TARGETS, budget, thin=thin)
    C.unstage(narrow)
    return with_copies(docs, model, fitted, id_col, text_col), model, fitted


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    out, model, _ = mix(docs.select("doc_id", "text"), label_domains(C.read(spark, sf_dir, "labels"), docs))
    return out.select("doc_id", "tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", "copies")


QUERIES = {"op7_soft_mixing": op7_soft_mixing}

"""Operator 6: language identification by a string kernel.

The kernel of two texts is the blended spectrum of n-gram presence: over lower-cased letters (all else is
a space), the n-grams of 1 to 4 bytes that both contain, hashed into a fixed number of slots per length,
divided by the geometric mean of each text's own number. Nyström: m landmark texts stand for all training
texts, the map K(x, landmarks) K(landmarks)^(-1/2) makes the kernel linear, and one ridge regression per
language (one against the rest) is solved in that space. Both factors fold into one matrix, so a batch of
texts is scored by two matrix products: presence x landmarks, kernel x weights.

Training uses at most ``per_class`` rows of each language (the smallest id hashes, exact top-k): the
documented bound. Their presence bits (a fixed number per text, whatever its length) come to the driver,
never their texts. Prediction is one narrow pass over whole texts, without shuffle.

Defined cases: null text or a text without letters is ``und`` with score 0; rows with a null id or null
language are not learned from; without any labelled row every text is ``und``; equal texts get equal
predictions; all other columns, also of the names used here, pass through or are replaced as documented.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common as C

UNKNOWN = "und"
PER_CLASS = 500
LANDMARKS = 128
RIDGE = 1e-2
#: Slots for n-grams of 1, 2, 3 and 4 bytes.
SLOTS = (256, 2048, 4096, 4096)
WIDTH = sum(SLOTS)
#: Rows scored at a time: bounds the presence matrix to this many times WIDTH numbers.
ROWS = 128

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, dtype=bool)
_ASCII[97:123] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n texts x WIDTH) booleans: which n-gram slots each whole text fills."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), dtype=bool)
    flat = out.reshape(-1)
    longest = len(SLOTS)
    for lo in range(0, len(data), C.SLICE_BYTES):  # slices overlap by the longest n-gram
        hi = min(len(data), lo + C.SLICE_BYTES + longest - 1)
        part = _LETTER[data[lo:hi]].astype(np.uint32)
        owner = np.searchsorted(offsets, np.arange(lo, hi), "right") - 1
        code = np.zeros(len(part), dtype=np.uint32)
        base = 0
        for k, slots in enumerate(SLOTS, start=1):
            m = len(part) - k + 1
            if m <= 0:
                break
            code = (code[:m] << np.uint32(8)) | part[k - 1:]
            same = owner[:m] == owner[k - 1:]
            slot = code if k == 1 else (code * np.uint32(2654435761)) >> np.uint32(32 - slots.bit_length() + 1)
            flat[owner[:m][same] * WIDTH + base + slot[same].astype(np.int64)] = True
            base += slots
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII[_LETTER[data]])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = data[offsets[i]:offsets[i + 1]]
        if (text >= 128).any():
            found[i] = any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # m x WIDTH booleans
    weights: np.ndarray  # m x languages, Nyström map and ridge solution in one

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.maximum(rows.sum(axis=1, dtype=np.float32), 1)
        marks = np.maximum(self.landmarks.sum(axis=1, dtype=np.float32), 1)
        return (rows.astype(np.float32) @ self.landmarks.T.astype(np.float32)) / np.sqrt(own[:, None] * marks[None, :])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability per language: softmax of the regressions' outputs (targets 1 and -1)."""
        raw = 4.0 * (self.kernel(rows) @ self.weights)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit_rows(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on presence rows; the first rows of each language are its landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return None
    which = np.array([languages.index(x) for x in labels])
    share = -(-landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(which == k)[:share] for k in range(len(languages))])
    model = Model(languages, bits[marks], np.zeros((len(marks), len(languages)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(bits[marks]).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = model.kernel(bits).astype(np.float64) @ root
    target = np.where(which[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    weight = 1.0 / np.bincount(which, minlength=len(languages))[which]  # each language weighs the same
    weight /= weight.sum()
    gram = phi.T @ (phi * weight[:, None]) + ridge / max(phi.shape[1], 1) * np.eye(phi.shape[1])
    model.weights = (root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_class: int = PER_CLASS, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from labelled rows whose fold is not 2, at most ``per_class`` of each language."""
    C.prepare(df.sparkSession)
    rows = df.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 2)).select(
        F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    chosen = C.hash_sample(rows.select("id", "label").distinct(), "label", "id", F.lit(per_class))
    # bounded: per_class rows per language
    picked = rows.join(F.broadcast(chosen), ["id", "label"])
    # an id may be repeated over much of the table: one text of each leaves the executors
    one = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text"))
    picked = picked.groupBy("id", "label").agg(one.alias("text")).select("id", "label", F.xxhash64("id").alias("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in C.text_groups(batch.column(3)):
                ok = has_letter(data, offs)
                packed = np.packbits(presence(data, offs), axis=1)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(ok)],
                                                 ["id", "label", "k", "bits", "ok"])

    got = picked.mapInArrow(run, "id string, label string, k long, bits binary, ok boolean").where("ok").drop("ok").toPandas()
    got = got.sort_values(["label", "k", "id", "bits"])
    if got.empty:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(b) for b in got["bits"]), np.uint8).reshape(len(got), -1), axis=1)[:, :WIDTH].astype(bool)
    return fit_rows(bits, got["label"].tolist(), landmarks)


def classify(df: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score (0 to 1); columns of those names are replaced."""
    spark = df.sparkSession
    C.prepare(spark)
    base = df.drop(pred_col, score_col)
    at = base.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # landmarks x WIDTH bits and small weights: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            best, score = [], []
            for lo, hi, data, offs in C.text_groups(batch.column(at)):
                for a in range(0, hi - lo, ROWS):
                    b = min(a + ROWS, hi - lo)
                    part, bounds = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                    ok = has_letter(part, bounds)
                    if known is None:
                        best.extend([UNKNOWN] * (b - a))
                        score.extend([0.0] * (b - a))
                        continue
                    p = known.score(presence(part, bounds))
                    top = p.argmax(axis=1)
                    best.extend(known.languages[t] if o else UNKNOWN for t, o in zip(top, ok))
                    score.extend(float(x) if o else 0.0 for x, o in zip(p.max(axis=1), ok))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names, pred_col, score_col])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def op6_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs)
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_kernel_language_id": op6_kernel_language_id}

"""Operator 1: document fingerprints by one-permutation MinHash.

Every shingle hash is computed once: its high bits name a bin, its remaining bits compete for
the bin's minimum. Empty bins borrow the minimum of a non-empty bin chosen by a per-bin random
order of all bins (optimal densification: each empty bin draws uniformly among the non-empty
ones, independently of its neighbours, and equally in every document). Of each bin only the low
``bits`` bits are stored, packed; likeness removes the chance agreement of 2**-bits.

Defined cases: null text = empty text; an empty text or one without words has the fingerprint
``''``; two empty fingerprints have likeness 1, an empty and a non-empty one 0. Texts are taken
whole, whatever their length. Rows with equal ids are ordered by text; equal rows stay rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BINS = 256
BITS = 4


@lru_cache(maxsize=4)
def _order(bins: int) -> np.ndarray:
    """Row i: rank of every bin in bin i's random order."""
    draws = C.stream(bins * bins, 4242).reshape(bins, bins)
    return np.argsort(np.argsort(draws, axis=1), axis=1).astype(np.int32)


def sketch(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Low-order bits per bin (n texts x bins, uint8); 255 in every bin of a text without words. ``bits`` <= 7."""
    n, shift = len(offsets) - 1, C.U64(64 - (bins.bit_length() - 1))
    hashes, owner, _ = C.shingle_hashes(data, offsets)
    least = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, owner * bins + (hashes >> shift).astype(np.int64),
                  hashes & ((C.U64(1) << shift) - C.U64(1)))
    least = least.reshape(n, bins)
    filled = least != np.iinfo(np.uint64).max
    out = (least & C.U64((1 << bits) - 1)).astype(np.uint8)
    order = _order(bins)
    for i in np.flatnonzero(~filled.all(axis=1)):
        have = np.flatnonzero(filled[i])
        if not len(have):
            out[i] = 255
            continue
        gaps = np.flatnonzero(~filled[i])
        out[i, gaps] = out[i, have[order[np.ix_(gaps, have)].argmin(axis=1)]]
    return out


def pack(row: np.ndarray, bits: int = BITS) -> str:
    """Hexadecimal of the packed low-order bits; ``''`` for a text without words."""
    if row[0] == 255:
        return ""
    planes = (row[:, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(-1)).tobytes().hex()


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected likeness per row of two sketches, 0 to 1."""
    chance = 2.0 ** -bits
    raw = ((a == b).mean(axis=1) - chance) / (1 - chance)
    empty_a, empty_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), np.clip(raw, 0.0, 1.0))


def likeness(a, b, bits: int = BITS):
    """Column: likeness of two fingerprint columns (null if either is null)."""

    @F.pandas_udf("double")
    def compare(x, y):
        import pandas as pd

        def one(p, q):
            if p is None or q is None:
                return None
            if not p or not q:
                return float(p == q)
            return float(similarity(unpack(p, bits)[None], unpack(q, bits)[None], bits)[0])

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="float64")

    return compare(a, b)


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``df`` with the fingerprint of each whole text; a narrow pass, no shuffle. ``out_col`` replaces a column of that name."""
    C.prepare(df.sparkSession)
    keep = df.drop(out_col)
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[str] = []
            for _, _, data, offs in C.text_groups(batch.column(at)):
                prints.extend(pack(r, bits) for r in sketch(data, offs, bins, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType
    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField(out_col, StringType())]))


def _splits(ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 cut points of the ids: bounded by the number of partitions, not by the data."""
    if parts < 2:
        return []
    return sorted({int(x) for x in ids.approxQuantile("__llm_id", [i / parts for i in range(1, parts)], 0.2 / parts)})


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text) dealt into id ranges and sorted, each range closed by a copy of its successor's first row.

    Columns ``__llm_part``, ``__llm_id``, ``__llm_text``, ``__llm_extra`` (1: the closing copy). Only one row
    per range is sent twice, so the whole text crosses the network once. The last range is closed by the first row.
    """
    spark = df.sparkSession
    parts = C.partitions(spark)
    # a null id sorts first
    rows = df.select(F.col(id_col).cast("long").alias("__llm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__llm_text"))
    ids = rows.select("__llm_id")
    cuts = _splits(ids, parts)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.when(F.col("__llm_id").isNull(), F.lit(0)).otherwise(
        F.size(F.filter(bounds, lambda c: c <= F.col("__llm_id")))).cast("int")
    # first id of every non-empty range: at most one row per partition comes to the driver
    heads = sorted((r["p"], r["any_null"], r["first"]) for r in ids.select(part.alias("p"), "__llm_id").groupBy("p").agg(
        F.min("__llm_id").alias("first"), F.max(F.col("__llm_id").isNull()).alias("any_null")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("__llm_part"), "*", F.lit(0).alias("__llm_extra"))
    closes = [(None if n else f, heads[i - 1][0]) for i, (_, n, f) in enumerate(heads)]  # i = 0 closes the last range
    table = spark.createDataFrame(closes, "__llm_first long, __llm_part int")
    firsts = (rows.join(F.broadcast(table), F.col("__llm_id").eqNullSafe(F.col("__llm_first")))
              .groupBy("__llm_part", "__llm_id").agg(F.min("__llm_text").alias("__llm_text")))
    dealt = rows.select(part.alias("__llm_part"), "*", F.lit(0).alias("__llm_extra")).union(
        firsts.select("__llm_part", "__llm_id", "__llm_text", F.lit(1).alias("__llm_extra")))
    return (dealt.repartitionByRange(parts, "__llm_part")
            .sortWithinPartitions("__llm_part", "__llm_extra", F.col("__llm_id").asc_nulls_first(), "__llm_text"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprint of every text, of its edited text, and both likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all)
    of the next row's text, in ascending id; the last row's next is the first. Columns: id,
    text, edited_text, n_chars, fingerprint, edited_fingerprint, near_edited, near_next.
    An empty table gives an empty result; a single row is its own next.
    """
    C.prepare(df.sparkSession)

    def emit(rows: list[tuple[int, str]], follow: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, follow)]
        both = texts + edited + follow[-1:]
        marks = np.concatenate([sketch(d, o, bins, bits) for _, _, d, o in C.text_groups(pa.array(both, pa.large_string()))])
        n = len(rows)
        own, new, nxt = marks[:n], marks[n:2 * n], np.concatenate([marks[1:n], marks[2 * n:]])
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array(texts, pa.string()), pa.array(edited, pa.string()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([pack(r, bits) for r in own], pa.string()), pa.array([pack(r, bits) for r in new], pa.string()),
            pa.array(similarity(own, new, bits), pa.float64()), pa.array(similarity(own, nxt, bits), pa.float64()),
        ], ["id", "text", "edited_text", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        follow: list[str] = []
        size = 0
        for batch in batches:
            for i, text, extra in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if len(held) > len(follow):
                    follow.append(text)
                    if size >= C.GROUP_BYTES:
                        yield emit(held, follow)
                        held, follow, size = [], [], 0
                if not extra:
                    held.append((i, text))
                    size += len(text)
        if held:
            yield emit(held, follow)

    return with_next(df, id_col, text_col).mapInArrow(
        run, "id long, text string, edited_text string, n_chars long, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op1_minhash_fingerprints": op1_minhash_fingerprints}

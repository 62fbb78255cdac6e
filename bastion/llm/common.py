"""Shared helpers of the training-data operators: staged tables, Arrow text batches,
word and shingle hashing, connected components.

Internal columns start with ``__llm_`` so that they never clash with caller columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bastion.session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one vectorised step works on; longer rows are cut at white space inside a step.
SLICE_BYTES = 1 << 20
#: Rows are taken together until they hold this many bytes.
GROUP_BYTES = 4 << 20
#: Words per shingle of every near-duplicate operator.
SHINGLE = 5

U64 = np.uint64


# ---------------------------------------------------------------- staged tables

def prepare(spark: SparkSession) -> str:
    """Ship the package to the workers and return the shared folder for staged tables."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like ``checkpoint()`` but computes the input once and keeps columns
    compressed and prunable. The path is kept on the result for :func:`unstage`.
    """
    spark = df.sparkSession
    path = f"{prepare(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_llm_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions: it follows the data, as the submitter set it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over a uint64 array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` reproducible 64-bit values from a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = stream(256, 17)[_LOWER]
_BASE = U64(0x2545F4914F6CDD1D)
_POWERS = np.ones(1, dtype=U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, dtype=U64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def _cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about SLICE_BYTES that end at a document's end or just after white space."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(end, lo + SLICE_BYTES)
        if hi < end:
            spaces = np.flatnonzero(space[data[lo:hi]])
            bound = offsets[np.searchsorted(offsets, hi, "right") - 1]
            best = max(int(bound), lo + int(spaces[-1]) + 1 if len(spaces) else lo)
            if best <= lo:  # one word longer than a slice
                after = np.flatnonzero(space[data[hi:]])
                nxt = offsets[np.searchsorted(offsets, hi, "left")]
                best = min(int(nxt), hi + int(after[0]) + 1 if len(after) else end)
            hi = best
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs of bytes not in ``space``: 0x20, 0x09-0x0D; A-Z lower-cased) and its text's index.

    ``data`` holds the UTF-8 bytes of all texts one after another, ``offsets`` their n + 1 bounds from 0.
    """
    words, owners = [], []
    with np.errstate(over="ignore"):
        for lo, hi in _cuts(data, offsets, space):
            part = data[lo:hi]
            solid = ~space[part]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            heads = offsets[np.searchsorted(offsets, lo, "left"):np.searchsorted(offsets, hi, "left")] - lo
            heads = heads[(heads >= 0) & (heads < hi - lo)]
            first[heads] = solid[heads]
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            place = np.arange(hi - lo, dtype=np.int64)
            place -= starts[np.maximum(np.cumsum(first) - 1, 0)]
            place[~solid] = 0
            values = _BYTE[part] * _powers(int(place.max()) + 1)[np.maximum(place, 0)]
            values[~solid] = 0
            words.append(mix(np.add.reduceat(values, starts)))
            owners.append(np.searchsorted(offsets, starts + lo, "right") - 1)
    if not words:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(owners)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles with their text's index, in text order, and words per text.

    A text of 1 to ``size`` - 1 words has one shingle, its whole sequence; a text without words has none.
    """
    words, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    multiplier = U64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            acc = words[:len(words) - size + 1].copy()
            for i in range(1, size):
                acc *= multiplier
                acc += words[i:len(words) - size + 1 + i]
            inside = owner[:len(acc)] == owner[size - 1:]
            full, full_owner = mix(acc[inside]), owner[:len(acc)][inside]
        else:
            full, full_owner = np.zeros(0, U64), np.zeros(0, np.int64)
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            begin = np.concatenate([[0], np.cumsum(counts)])
            whole = np.zeros(len(few), U64)
            for k, i in enumerate(few):
                acc1 = U64(counts[i])
                for w in words[begin[i]:begin[i + 1]]:
                    acc1 = acc1 * multiplier + w
                whole[k] = acc1
            full = np.concatenate([full, mix(whole ^ U64(0xA5A5A5A5A5A5A5A5))])
            full_owner = np.concatenate([full_owner, few])
            order = np.argsort(full_owner, kind="stable")
            full, full_owner = full[order], full_owner[order]
    return full, full_owner, counts


# ---------------------------------------------------------------- Arrow text batches

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds (from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[bounds[0]:bounds[-1]], bounds - bounds[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def row_groups(bounds: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of groups of rows, whole texts only."""
    data, bounds = utf8(column)
    for lo, hi in row_groups(bounds):
        yield lo, hi, data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo]


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner, _ = shingle_hashes(data, offsets)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


# ---------------------------------------------------------------- connected components

def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph with long columns ``a``, ``b``; component = smallest node.

    Alternating large-star and small-star rounds; every round is a written table in the
    shared folder, the one before it is deleted. Self-loops and repeated edges are allowed,
    edges with a null end are no edges. Nodes of self-loops only come out as their own component.
    """
    nodes = stage(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                  .where("a is not null and b is not null").distinct(), "edges")
    cur, last = nodes.where("a <> b"), None
    held: DataFrame | None = None
    for _ in range(most_rounds):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        new = stage(small.where("a <> b").distinct(), "cc")
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        unstage(held)
        cur, held = new, new
        if not mark["n"] or last == (mark["n"], mark["h"]):
            break
        last = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = nodes.select(F.col("a").alias("node")).union(nodes.select(F.col("b").alias("node")))
    labels = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    out = stage(ends.distinct().join(labels, "node", "left")
                .select("node", F.coalesce("component", "node").alias("component")), "components")
    unstage(held)
    unstage(nodes)
    return out


# ---------------------------------------------------------------- samples

def hash_sample(rows: DataFrame, class_col: str, id_col: str, most: Column) -> DataFrame:
    """The ``most`` rows of each class with the smallest id hashes; ``most`` may depend on the class.

    Classes are few (languages, labels, domains): their counts are broadcast. A row whose hash lies above what
    ``most`` and a margin of six standard deviations of its class's rows need is dropped before the ranking,
    so a class of any size brings about ``most`` rows to one task.
    """
    counts = rows.groupBy(class_col).agg(F.count("*").alias("__llm_n"))
    few = F.coalesce(most, F.lit(0)).cast("double")
    share = (few + 6 * F.sqrt(few) + 20) / F.col("__llm_n")
    draw = F.shiftrightunsigned("__llm_draw", 11) / F.lit(2.0 ** 53)
    rank = Window.partitionBy(class_col).orderBy(draw, "__llm_draw", id_col)
    return (rows.withColumn("__llm_draw", F.xxhash64(F.col(id_col))).join(F.broadcast(counts), class_col).where(draw <= share)
            .withColumn("__llm_k", F.row_number().over(rank)).where(F.col("__llm_k") <= most).select(*rows.columns))

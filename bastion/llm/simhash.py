"""Operator 11: SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits; a bit is 1 if more than half of the XXH64 hashes (seed 42) of its 3-word
shingles, repeats included, have it. Two texts link when their fingerprints differ in at most ``RADIUS`` bits;
the result is each text's connected component. The steps:

1. Equal fingerprints fall into one point; all later steps see distinct points only.
2. Distance tables. ``PIVOTS`` fixed reference fingerprints span coordinates: a point's Hamming distance to each.
   By the triangle inequality no coordinate of two linked points differs by more than RADIUS. A coordinate is
   cut into intervals of 2 RADIUS + 1; a point lies in the cell of its intervals and, where it is within RADIUS
   below an interval's end, in the next one too. Linked points therefore share a cell, and points of different
   cells are never paired. Cells start with as many pivots as the number of points asks for; those that hold over
   ``MOST`` points are cut by further pivots, until none does. What is left when the pivots are used up (many points
   within a few bits of each other) is cut into blocks that meet pairwise as cells of their own.
3. Filter and verify. A task takes whole cells and cuts them by ``LOCAL`` further pivots in the same way, in memory, to
   about ``SMALL`` points. Sorted by the distance to one more pivot, a point is compared only with those of its small cell that
   are at most RADIUS further in that order; pairs whose largest coordinate difference over the ``REST`` other pivots is
   over RADIUS are discarded, and the differing bits of the survivors are counted. Only spanning links leave a task.

The result is exact: the filters never drop a linked pair. Nothing is collected to the driver but one count a round.

Defined cases: null text = empty text; a text without words has the fingerprint 0 and links like any other;
one or two words make one shingle, the whole sequence; rows with null ids take part, the component's name is the
smallest non-null id (null if there is none); rows of one id are judged by their own texts; repeated rows stay rows;
an empty table gives an empty result; extra columns are ignored, whatever their names. Long texts are hashed in
pieces, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Words a shingle; seed of its hash; bits that linked fingerprints may differ in.
WORDS, SEED, RADIUS = 3, 42, 2
#: Reference fingerprints: of the cells, of the cuts within a task, and of the filter.
PIVOTS, LOCAL, REST = 24, 10, 4
#: Points of a cell that a task takes whole, rows of a task, and points of a cell that is swept.
MOST, TASK_ROWS, SMALL = 1 << 16, 1 << 16, 512
#: Pivots that a round adds to a cell which holds too many points.
STEP = 2

_REFERENCES = C.stream(PIVOTS + LOCAL + REST, 1111)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- fingerprints

def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lists of words whose windows of WORDS are, together, all windows of the text (each once)."""
    lo, end, tail = 0, len(text), []
    while lo < end:
        hi = end
        if end - lo > C.SLICE_BYTES:
            blank = _BLANK.search(text, lo + C.SLICE_BYTES)
            hi = blank.start() if blank else end
        words = tail + text[lo:hi].translate(_FOLD).split()
        yield words
        tail, lo = words[1 - WORDS:], hi


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of all windows of WORDS words, joined by one space."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    joined, starts = b" ".join(words), (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:].tolist())], np.uint64)


def fingerprints_of(texts: Iterator[bytes]) -> np.ndarray:
    """The fingerprint (uint64) of each whole text, given as UTF-8."""
    ones: list[np.ndarray] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.cumsum([0] + [len(h) for h in held[:-1]])
            for owner, row in zip(owners, np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)):
                ones[owner] = ones[owner] + row
            held.clear()
            owners.clear()

    pending = 0
    for i, text in enumerate(texts):
        ones.append(np.zeros(64, np.int64))
        sizes.append(0)
        words: list[bytes] = []
        for words in _pieces(text):
            if len(words) >= WORDS:
                held.append(_hashes(words))
                owners.append(i)
                sizes[i] += len(held[-1])
                pending += len(held[-1])
            if pending > 1 << 17:
                flush()
                pending = 0
        if not sizes[i] and words:
            held.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
            owners.append(i)
            sizes[i] = 1
    flush()
    if not ones:
        return np.zeros(0, np.uint64)
    set_bits = 2 * np.array(ones) > np.array(sizes)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, point) of every row; ``point`` is the fingerprint's 64 bits as a signed long. A narrow pass."""
    C.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = C.utf8(batch.column(1))
            points = fingerprints_of(data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points.view(np.int64))], ["id", "point"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, point long")


def as_hex(point):
    """Column: 16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(point), 16, "0"))


# ---------------------------------------------------------------- cells

def distances(points: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(points x pivots) Hamming distances to the references lo to hi - 1."""
    return np.bitwise_count(points.view(np.uint64)[:, None] ^ _REFERENCES[None, lo:hi]).astype(np.int16)


def _cut(points: np.ndarray, cells: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): each cell cut by the pivots lo to hi - 1; rows near an interval's end lie in two."""
    width = 2 * RADIUS + 1
    table, row = distances(points, lo, hi), np.arange(len(points))
    cells = cells.view(np.uint64).copy()
    for k in range(hi - lo):
        place = table[row, k]
        near = place % width >= width - RADIUS
        interval = (np.concatenate([place // width, place[near] // width + 1]) + 1).astype(np.uint64)
        row, cells = np.concatenate([row, row[near]]), np.concatenate([cells, cells[near]])
        with np.errstate(over="ignore"):
            cells = C.mix(cells * C.U64(0x9E3779B97F4A7C15) + interval)
    return row, cells.view(np.int64)


def _cut_rows(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """(cell, point) rows with their cells cut by further pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, points = (batch.column(k).to_numpy() for k in (0, 1))
            for a in range(0, len(points), 2048):
                row, cut = _cut(points[a:a + 2048], cells[a:a + 2048], lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(points[a:a + 2048][row])], ["cell", "point"])

    return rows.select("cell", "point").mapInArrow(run, "cell long, point long")


def cells(points: DataFrame, most: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(cell, point) rows, at most 2 ``most`` of a cell; linked points share a cell. Also the staged tables it reads."""
    most = most or MOST
    spark = points.sparkSession
    count = points.count()
    # a pivot leaves about 2 ** -1.25 of a cell's points in each of its parts
    depth = min(PIVOTS, max(0, math.ceil(math.log2(max(count, 1) / most) / 1.25)))
    level = points.select(F.lit(0).cast("long").alias("cell"), "point")
    if depth:
        level = _cut_rows(level, 0, depth)
    done, held = [], []
    while True:
        level = C.stage(level, "cells")
        held.append(level)
        full = level.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
        full = C.stage(full, "full_cells")
        held.append(full)
        if full.isEmpty():
            done.append(level)
            break
        done.append(level.join(full, "cell", "left_anti"))
        over = level.join(full, "cell")
        if depth < PIVOTS:
            level, depth = _cut_rows(over, depth, min(PIVOTS, depth + STEP)), min(PIVOTS, depth + STEP)
            continue
        blocks = F.ceil(F.col("n") / F.lit(most)).cast("int")
        mine = over.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("point"), "blocks").cast("int"))
        meet = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        done.append(meet.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "point"))
        break
    out = done[0].select("cell", "point")
    for more in done[1:]:
        out = out.union(more.select("cell", "point"))
    return out, held


# ---------------------------------------------------------------- filter and verify

def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0 .. n - 1 by the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _close(frame: pd.DataFrame) -> pd.DataFrame:
    """Spanning links (a, b) between the points of whole cells."""
    points, cell = frame["point"].to_numpy(), frame["cell"].to_numpy()
    n, row = len(points), np.arange(len(points))
    largest = np.unique(cell, return_counts=True)[1].max()
    cuts = min(LOCAL, max(0, math.ceil(math.log2(largest / SMALL) / 1.25)))
    if cuts:
        row, cell = _cut(points, cell, PIVOTS, PIVOTS + cuts)
    _, cell = np.unique(cell, return_inverse=True)
    table = distances(points, PIVOTS + LOCAL, PIVOTS + LOCAL + REST)
    place = cell.astype(np.int64) * 256 + table[row, 0]  # cells lie far apart in this order
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    bits, table = points.view(np.uint64)[row], table[row]
    until = np.searchsorted(place, place + RADIUS, "right")
    link, active, step, pairs, found = np.arange(n), np.arange(len(row)), 0, [], 0
    while True:
        step += 1
        active = active[until[active] > active + step]
        if not len(active):
            break
        near = active[np.abs(table[active, 1] - table[active + step, 1]) <= RADIUS]
        near = near[(np.abs(table[near, 2:] - table[near + step, 2:]) <= RADIUS).all(axis=1)]
        near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= RADIUS]
        if len(near):
            pairs.append((row[near], row[near + step]))
            found += len(near)
        if found > 1 << 20:  # keep a forest of what was found so far
            link = _merge(link, pairs)
            pairs, found = [], 0
    link = _merge(link, pairs)
    some = np.flatnonzero((link != np.arange(n)) & (points != points[link]))
    return pd.DataFrame({"a": points[some], "b": points[link[some]]})


def _merge(link: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    own = np.arange(len(link))
    return roots(len(link), np.concatenate([own, *[a for a, _ in pairs]]), np.concatenate([link, *[b for _, b in pairs]]))


def links(points: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) links between distinct points whose closure is that of all links. The result is staged."""
    rows, held = cells(points, most)
    tasks = max(C.partitions(points.sparkSession), math.ceil(rows.count() / TASK_ROWS))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)))
    out = C.stage(dealt.groupBy("task").applyInPandas(_close, "a long, b long"), "pivot_links")
    for used in held:
        C.unstage(used)
    return out


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """(id, point, component_id) of every row; component_id is the smallest id reachable by links."""
    profile = C.stage(fingerprints(df, id_col, text_col), "fingerprints")
    points = C.stage(profile.groupBy("point").agg(F.min("id").alias("lead")), "points")
    edges = links(points, most)
    label = C.connected_components(edges)
    C.unstage(edges)
    named = points.join(label, F.col("point") == F.col("node"), "left").select(
        "point", "lead", F.coalesce("component", "point").alias("component"))
    heads = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    return profile.join(named.join(heads, "component").select("point", "component_id"), "point").select("id", "point", "component_id")


def op11_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(C.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), as_hex(F.col("point")).alias("fingerprint"), "component_id")


QUERIES = {"op11_pivot_simhash": op11_pivot_simhash}

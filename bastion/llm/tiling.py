"""Operator 10: benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Documents and benchmark items that share a seed
(``least`` words in a row) are candidate pairs. Each pair is tiled: the longest common run of
unmarked words is marked in both, again and again, until none of ``least`` words is left; runs are
found by running Karp-Rabin hashes of a search length that follows the longest match down. Tiles
may lie anywhere, so a reordered passage is covered as well as a verbatim one. A document is
contaminated by an item when its tiles cover at least ``cover`` of the item's words.

The benchmark is a stated query set: it is cut into blocks of a bounded number of words, each block
is broadcast in turn, and every block meets all documents in a narrow pass, without shuffle.

Defined cases: null or empty texts share nothing; items of fewer than ``least`` words cannot be told
from chance and match nothing; equal items match alike; texts are taken whole; repeated rows are
judged one by one; an empty benchmark or table gives no matches; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

LEAST = 5
COVER = 0.5
#: Words of the benchmark that are broadcast at a time (8 bytes each, and about 12 for their seeds).
BLOCK_WORDS = 1 << 20

_BASE = C.U64(0x9E3779B97F4A7C15)
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds per row) of groups of whole texts."""
    for lo, hi, data, offs in C.text_groups(pc.utf8_lower(column.cast(pa.large_string()))):
        hashes, owner = C.word_hashes(data, offs, _GAP)
        yield lo, hi, hashes, np.searchsorted(owner, np.arange(hi - lo + 1))


def prefix(seq: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: out[i + s] - out[i] * base**s is the hash of seq[i:i + s]."""
    out = np.zeros(len(seq) + 1, dtype=C.U64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[C.U64(1)], np.full(len(seq), _BASE)]).astype(C.U64))
        inverse = C.U64(pow(int(_BASE), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([[C.U64(1)], np.full(len(seq), inverse)]).astype(C.U64))
        out[1:] = np.cumsum(seq * back[1:], dtype=C.U64) * power[1:]
    return out


def running(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    if len(sums) <= size:
        return np.zeros(0, C.U64)
    with np.errstate(over="ignore"):
        return C.mix(sums[size:] - sums[:-size] * C.U64(pow(int(_BASE), size, 1 << 64)))


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(marked)])
    return seen[size:] == seen[:-size]


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; ties by place in doc, then in item."""
    if min(len(doc), len(item)) < least:
        return []
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    doc_sums, item_sums = prefix(doc), prefix(item)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)) // 2)
    while True:
        found = _scan(doc, item, doc_sums, item_sums, in_doc, in_item, size)
        if len(found) and found[0, 0] > 2 * size:
            size = int(found[0, 0])
            continue
        for length, d, i in map(np.ndarray.tolist, found):  # longest first
            if not in_doc[d:d + length].any() and not in_item[i:i + length].any():
                in_doc[d:d + length] = in_item[i:i + length] = True
                tiles.append((d, i, length))
                if len(item) - in_item.sum() < least:  # nothing is left to match
                    return tiles
        if len(found):
            continue  # what an occluded match left over may still hold ``size`` words
        if size == least:
            return tiles
        size = max(least, size // 2)


def _runs(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, places) of runs of equal windows one after another, among the windows at ``at`` (ascending)."""
    key = keys[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    return key[head], at[head], np.diff(np.append(head, len(at)))


def _scan(doc, item, doc_sums, item_sums, in_doc, in_item, size) -> np.ndarray:
    """Rows (words, place in doc, place in item) of the maximal runs of at least ``size`` unmarked common words, longest first.

    Equal windows that follow one another (a repeated word) are taken as a run: two runs meet in one interval per diagonal, so
    the work is their sum and never their product.
    """
    item_keys, doc_keys = running(item_sums, size), running(doc_sums, size)
    item_at, doc_at = np.flatnonzero(_free(in_item, size)), np.flatnonzero(_free(in_doc, size))
    none = np.zeros((0, 3), np.int64)
    if not len(item_at) or not len(doc_keys):
        return none
    key, i0, many_i = _runs(item_keys, item_at)
    order = np.argsort(key, kind="stable")
    key, i0, many_i = key[order], i0[order], many_i[order]
    doc_at = doc_at[np.isin(doc_keys[doc_at], key)]
    if not len(doc_at):
        return none
    doc_key, d0, many_d = _runs(doc_keys, doc_at)
    first, last = np.searchsorted(key, doc_key, "left"), np.searchsorted(key, doc_key, "right")
    many = last - first
    x = np.repeat(np.arange(len(d0)), many)
    y = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    # one interval for each diagonal on which the two runs meet
    spans = many_d[x] + many_i[y] - 1
    pair = np.repeat(np.arange(len(x)), spans)
    x, y = x[pair], y[pair]
    diagonal = d0[x] - i0[y] - many_i[y] + 1 + np.arange(len(pair)) - np.repeat(np.cumsum(spans) - spans, spans)
    begin = np.maximum(d0[x], i0[y] + diagonal)
    end = np.minimum(d0[x] + many_d[x], i0[y] + many_i[y] + diagonal)
    # intervals of one diagonal that touch are one match
    order = np.lexsort((begin, diagonal))
    diagonal, begin, end = diagonal[order], begin[order], end[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != end[:-1]) | (diagonal[1:] != diagonal[:-1])
    head = np.flatnonzero(new)
    d, length = begin[head], end[np.append(head[1:], len(begin)) - 1] - begin[head] + size - 1
    i = d - diagonal[head]
    order = np.lexsort((i, d, -length))
    return np.stack([length[order], d[order], i[order]], axis=1)


class Block:
    """Benchmark items with an index of their seeds."""

    def __init__(self, ids: list, items: list[np.ndarray], least: int):
        self.ids, self.items, self.least = ids, items, least
        seeds = [running(prefix(x), least) for x in items]
        seed = np.concatenate([np.zeros(0, C.U64), *seeds])
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds]).astype(np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order]
        self.table = np.zeros(1 << 20, bool)  # a first, cheap test by low bits
        self.table[(self.seed & C.U64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, doc: np.ndarray, cover: float, doc_seeds: np.ndarray | None = None) -> list[tuple[int, float, list]]:
        """(item index, coverage, tiles) of every item covered at least to ``cover``."""
        if doc_seeds is None:
            doc_seeds = running(prefix(doc), self.least)
        hit = doc_seeds[self.table[(doc_seeds & C.U64((1 << 20) - 1)).astype(np.int64)]]
        if not len(hit):
            return []
        hit = np.unique(hit)
        first, last = np.searchsorted(self.seed, hit, "left"), np.searchsorted(self.seed, hit, "right")
        hits: dict[int, int] = {}
        for a, b in zip(first, last):
            for k in self.owner[a:b]:
                hits[int(k)] = hits.get(int(k), 0) + 1
        out = []
        for k in sorted(hits):
            need = cover * len(self.items[k])
            if hits[k] * self.least < need:  # each seed covers ``least`` words at most
                continue
            tiles = tile(doc, self.items[k], self.least)
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= need:
                out.append((k, covered / len(self.items[k]), tiles))
        return out


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", least: int = LEAST, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words, so that the driver holds one block at a time."""
    C.prepare(bench.sparkSession)
    rows = bench.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, at in words(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(
                    [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "words"])

    items = C.stage(rows.mapInArrow(run, f"id {kind}, words binary").where(F.octet_length("words") >= 8 * least), "items")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    count = math.ceil(total / 8 / block_words)
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("id", "words"), F.lit(count)) == k).collect()  # about block_words words
        part.sort(key=lambda r: (r["id"] is not None, r["id"], bytes(r["words"])))
        yield Block([r["id"] for r in part], [np.frombuffer(bytes(r["words"]), C.U64) for r in part], least)


def _each(column: pa.Array, block: Block, cover: float) -> Iterator[tuple[int, list]]:
    for lo, _, hashes, at in words(column):
        sums = prefix(hashes) if len(hashes) < 1 << 22 else None
        seeds = running(sums, block.least) if sums is not None else None
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b - a >= block.least:
                own = None if seeds is None else seeds[a:b - block.least + 1]
                yield lo + k, block.matches(hashes[a:b], cover, own)


def contaminated(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 bench_text_col: str = "text", least: int = LEAST, cover: float = COVER) -> DataFrame:
    """One row per (document, item) covered enough: id, item_id, coverage, tiles (doc_word, item_word, words)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, item_words long, coverage double, tiles array<struct<doc_word: long, item_word: long, words: long>>"
    out = spark.createDataFrame([], schema)
    tile_type = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    for block in blocks(bench, item_col, bench_text_col, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                got = [(row, k, c, t) for row, found in _each(batch.column(1), block, cover) for k, c, t in found]
                if got:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([block.ids[g[1]] for g in got]),
                        pa.array([len(block.items[g[1]]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()),
                        pa.array([[dict(zip(("doc_word", "item_word", "words"), t)) for t in g[3]] for g in got], tile_type),
                    ], ["id", "item_id", "item_words", "coverage", "tiles"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def with_coverage(df: DataFrame, bench: DataFrame, text_col: str = "text", out_col: str = "coverage", item_col: str = "item_id",
                  bench_text_col: str = "text", least: int = LEAST, cover: float = COVER) -> DataFrame:
    """``df`` with the largest coverage of an item by each row, 0.0 where none reaches ``cover``; no shuffle."""
    spark = df.sparkSession
    names = df.drop(out_col).columns
    out = df.drop(out_col).withColumn(out_col, F.lit(0.0).cast(DoubleType()))
    at = names.index(text_col)
    schema = StructType([*out.schema.fields[:-1], StructField(out_col, DoubleType())])
    for block in blocks(bench, item_col, bench_text_col, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = np.array(batch.column(len(names)))
                for row, found in _each(batch.column(at), shared.value, cover):
                    best[row] = max([best[row], *(c for _, c, _ in found)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.float64())], batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def op10_greedy_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), "item_id", "item_words", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


QUERIES = {"op10_greedy_tiling_decontamination": op10_greedy_tiling_decontamination}

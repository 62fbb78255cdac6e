"""Operator 4: a uniform shuffle into shards of exact size.

The rows lie in P source partitions (by a hash of the row's key, so a rerun finds them there
again). Rows of one key are numbered, and the number is part of every draw, so that copies are dealt
apart like any other rows; the numbers come from counts by key and salt, so that no task holds all
rows of a key. All of this works on (row number, hash of the key); the rows themselves are written once with their
row number and joined with their shard and slot once, at the end. A communication matrix with the partitions' exact counts as row sums and the shards' exact
sizes as column sums is drawn from the multivariate hypergeometric law, which is the law of those
counts under a uniform shuffle. Each partition is permuted locally and cut by its matrix row, the
pieces are exchanged, and every shard is permuted again. The driver sees P counts and P x shards
numbers only.

Law ``rows``: shard row counts are at most one apart. Equal texts are not kept together; a uniform
shuffle cannot. Defined cases: rows with null keys hash like any other; rows equal in all key
columns take places of their own and may swap these with each other only; an empty table gives an empty result; a column
named ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 24


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good`` + ``bad``, for any sizes.

    The probabilities over the mode +- 12 standard deviations (all of them for small counts)
    come from the ratios of neighbours; what lies beyond weighs under 1e-30.
    """
    total = good + bad
    lo, hi = max(0, drawn - bad), min(drawn, good)
    if lo == hi:
        return lo
    mean = drawn * (good / total)
    sd = math.sqrt(mean * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    mode = min(max(math.floor((drawn + 1) * ((good + 1) / (total + 2))), lo), hi)
    width = int(12 * sd) + 12
    x = np.arange(max(lo, mode - width), min(hi, mode + width), dtype=np.float64)
    step = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.exp(logs - logs.max())
    cdf = np.cumsum(weight)
    at = int(np.searchsorted(cdf, rng.random() * cdf[-1], "right"))
    return max(lo, mode - width) + min(at, len(cdf) - 1)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: source partitions with sums ``counts``; columns: shards with sums ``sizes``."""
    rng = np.random.default_rng(seed)
    left, matrix = list(sizes), []
    for count in counts:
        row, pool = [], sum(left)
        for size in left:
            k = hypergeometric(rng, size, pool - size, count)
            row.append(k)
            count, pool = count - k, pool - size
        left = [a - k for a, k in zip(left, row)]
        matrix.append(row)
    return matrix


def numbered(df: DataFrame, key_cols: list[str], salts: int) -> DataFrame:
    """``df`` with ``__llm_no``: from 0 without gaps within the rows of a key. The rows are staged."""
    # consecutive rows get different salts; staged, because they must be the same for the counts and the rows
    rows = C.stage(df.withColumn("__llm_hash", F.xxhash64(*key_cols)).withColumn(
        "__llm_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), "salted")
    counts = rows.groupBy("__llm_hash", "__llm_salt").agg(F.count("*").alias("__llm_n"))
    before = Window.partitionBy("__llm_hash").orderBy("__llm_salt").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per salt
    start = counts.select("__llm_hash", "__llm_salt", F.sum("__llm_n").over(before).alias("__llm_start")).where("__llm_start > 0")
    within = Window.partitionBy("__llm_hash", "__llm_salt").orderBy(*key_cols)
    return (rows.withColumn("__llm_k", F.row_number().over(within) - 1).join(start, ["__llm_hash", "__llm_salt"], "left")
            .withColumn("__llm_no", F.col("__llm_k") + F.coalesce("__llm_start", F.lit(0)))
            .drop("__llm_hash", "__llm_salt", "__llm_k", "__llm_start"))


def places(rows: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(row, shard, slot) of rows (row, hash): the shuffle itself, on two numbers a row."""
    spark = rows.sparkSession
    parts = max(n_shards, C.partitions(spark))
    draw = lambda k: F.xxhash64("hash", "__llm_no", F.lit(seed), F.lit(k))
    rows = C.stage(numbered(rows, ["hash"], parts).withColumn("part", F.pmod(draw(1), F.lit(parts)).cast("int")), "numbered")
    found = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}  # at most `parts` rows
    total = sum(found.values())
    extra = set(np.random.default_rng(seed + 1).permutation(n_shards)[:total % n_shards].tolist())
    sizes = [total // n_shards + (s in extra) for s in range(n_shards)]
    order = sorted(found)
    matrix = communication_matrix([found[p] for p in order], sizes, seed)
    table = spark.createDataFrame([(p, np.cumsum(r).tolist()) for p, r in zip(order, matrix)], "part int, ends array<long>")
    # local permutation, cut by the matrix row; the table has a row per source partition
    local = Window.partitionBy("part").orderBy(draw(2), "row")
    dealt = (rows.withColumn("pos", F.row_number().over(local)).join(F.broadcast(table), "part")
             .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("pos"))).cast("int")))
    # second permutation: ranges of a random key, so that one shard is sorted by many tasks
    cells = max(1, math.ceil(parts / n_shards))
    cell = F.floor(F.shiftrightunsigned("key", 32) * F.lit(cells) / F.lit(2.0 ** 32)).cast("int")
    dealt = C.stage(dealt.select("row", "shard", draw(3).alias("key")).withColumn("cell", cell), "dealt")
    C.unstage(rows)
    ends = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("shard", "cell").count().collect())  # about `parts` rows
    offsets, at = [], {}
    for s, c, n in ends:
        offsets.append((s, c, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    begin = spark.createDataFrame(offsets, "shard int, cell int, begin long")
    again = Window.partitionBy("shard", "cell").orderBy("key", "row")
    return (dealt.withColumn("rank", F.row_number().over(again)).join(F.broadcast(begin), ["shard", "cell"])
            .select("row", "shard", (F.col("begin") + F.col("rank") - 1).alias("slot")))


def shuffle_into_shards(df: DataFrame, key_cols: list[str], n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard, the shuffled order)."""
    base = df.drop("shard", "slot")
    # staged: a row must have the same number in both reads
    rows = C.stage(base.withColumn("__llm_row", F.monotonically_increasing_id()), "rows")
    narrow = rows.select(F.col("__llm_row").alias("row"), F.xxhash64(*key_cols).alias("hash"))
    placed = places(narrow, n_shards, seed)
    return rows.join(placed, F.col("__llm_row") == F.col("row")).select(*[rows[c] for c in base.columns], placed["shard"], placed["slot"])


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = C.read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(docs, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_hypergeometric_shards": op4_hypergeometric_shards}

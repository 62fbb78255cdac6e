"""Operator 12: conversation prefix trie over minimal-perfect-hash node tables.

Every distinct sequence of the first d turns (role, text) of the conversations is a node of depth d; conversations
that start with it are its members. The steps:

1. Narrow rows. A turn becomes a 128-bit digest of its role and text and its number of bytes; texts are never shuffled.
   Rows are sorted by range over (conversation, turn, digest), so that even one conversation of very many turns is
   sorted by many tasks, and numbered within range and conversation; the few conversations that lie in several
   ranges get their offsets from the ranges before.
2. Prefix digests. A turn and its place hash to two 64-bit words; a prefix is the exclusive-or of the words of its turns.
   Blocks of ``BLOCK`` turns can be summed apart, so long conversations are. That all members of a node agree in its depth,
   its parent and (by a third word) its last turn is checked, or the run fails.
3. Nodes are counted by digest, partial sums first. Nodes of one member (the tails of conversations) follow from their
   conversation alone; only the first node of a tail goes on, as a child and leaf of its parent.
4. Shards. A node of over ``limit`` members is heavy. A subtree below a heavy node whose top is not heavy is a unit, units
   are dealt to shards by a hash, so a first turn that a third of all conversations share is cut below it. A unit holds at
   most ``limit`` conversations, and deep tries are worked on in bands of ``BAND`` depths, the deepest first.
5. A shard's task enumerates its distinct digests and builds a minimal perfect hash over them (levels of bit arrays; a
   digest that is alone in its place is set, the others go to the next level; the slot is the rank of its bit). A slot keeps
   its digest: a parent found in a slot of another digest is not in the shard. Counts are scattered into flat arrays by
   slot and added up through the array of parent slots, from the greatest depth up. What the tops of units hold is summed
   by parent and goes to the band above, and at last to the table of heavy nodes, at most ``HEAVY`` of them, which is one shard.

The SHA-256 of a node's ending members is one sequential hash over all of them, however many; their sorted ids are streamed
through it and never held.

Defined cases: turns are ordered by turn (null first), equal turns by the hex of their digests (SHA-256 of the role's length, a
colon, role and text); null role or text is empty; rows with a null conv_id belong to no conversation; repeated rows are
turns of their own; a conversation may have no turn (rebuilt ones); conversations without rows are none; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Members of a node that is not heavy, at least; heavy nodes at most; depths of a band; turns of a block; nodes of a shard.
LIMIT, HEAVY, BAND, BLOCK, SHARD_NODES = 4096, 1 << 20, 1024, 4096, 200_000
#: Rebuilt conversations: members of a family, and one more than the most turns that are taken from its first.
FAMILY, SHARED = 5, 9
NODE = ["p1", "p2"]


# ---------------------------------------------------------------- rows

def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; null = empty."""
    role = F.coalesce(role, F.lit(""))
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.coalesce(text, F.lit(""))), 256)


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, bytes) of every turn, places from 1 in each conversation; staged rows in sorted ranges."""
    parts = C.partitions(df.sparkSession)
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    # staged: the ranges must be the same for the counts and the rows
    rows = C.stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("part", "conv").agg(F.count("*").alias("n"))
    ends = rows.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    # only the first and last conversation of a range can lie in several: at most two rows a range
    edge = counts.join(F.broadcast(ends), "part").where("conv = low or conv = high")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = edge.select("part", "conv", F.sum("n").over(before).alias("start")).where("start > 0")
    within = Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    out = (rows.withColumn("k", F.row_number().over(within)).join(F.broadcast(start), ["part", "conv"], "left")
           .select("conv", (F.col("k") + F.coalesce("start", F.lit(0))).cast("long").alias("place"), "digest", "bytes"))
    staged = C.stage(out, "places")
    C.unstage(rows)
    return staged


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv, place, digest, bytes) of rebuilt conversations, and all their conv ids.

    Conversation c starts with the first h turns of c - c % family, h = crc32(decimal c) % shared, and goes on with its own
    turns after its first h. The remainder has the sign of c, as in SQL.
    """
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("long")
    convs = turns.select("conv").distinct().select("conv", taken.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = turns.where((F.col("place") < shared) & (F.col("conv") % family == 0))  # a few turns of some conversations
    lent = heads.groupBy(F.col("conv").alias("base")).agg(F.collect_list(F.struct("place", "digest", "bytes")).alias("head"))
    known = convs.join(lent, "base", "left").select(
        "conv", "h", F.filter(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:string,bytes:bigint>>")),
                              lambda t: t["place"] <= F.col("h")).alias("head"))
    first = known.select("conv", F.inline("head"))
    rest = (turns.withColumn("h", taken).where("place > h")
            .join(known.select("conv", F.size("head").cast("long").alias("lent")), "conv")
            .select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "bytes"))
    return first.union(rest), convs.select("conv")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, word, bytes, last): every conversation's way from the root.

    q is the parent's digest; the root's own digest is (0, 0) and so is its q. ``word`` tells the last turn.
    """
    rows = turns.select("conv", F.col("place").alias("depth"), "bytes", F.floor((F.col("place") - 1) / BLOCK).alias("block"),
                        *[F.xxhash64("digest", "place", F.lit(k)).alias(f"w{k}") for k in (1, 2)], F.xxhash64("digest").alias("word"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("w1").alias("s1"), F.bit_xor("w2").alias("s2"), F.max("depth").alias("top"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK turns
    zero = F.lit(0).cast("long")
    start = sums.select("conv", "block", F.coalesce(F.bit_xor("s1").over(before), zero).alias("s1"),
                        F.coalesce(F.bit_xor("s2").over(before), zero).alias("s2"), F.max("top").over(Window.partitionBy("conv")).alias("length"))
    mine = rows.withColumn("x1", F.bit_xor("w1").over(upto)).withColumn("x2", F.bit_xor("w2").over(upto)).join(start, ["conv", "block"])
    way = mine.withColumn("p1", F.col("x1").bitwiseXOR(F.col("s1"))).withColumn("p2", F.col("x2").bitwiseXOR(F.col("s2"))).select(
        "conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("w1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("w2")).alias("q2"),
        "word", "bytes", (F.col("depth") == F.col("length")).alias("last"))
    tops = convs.join(sums.where("block = 0").select("conv", F.lit(1).alias("some")), "conv", "left").select(
        "conv", *[zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "word", "bytes")], F.col("some").isNull().alias("last"))
    return tops.union(way)


def checked_nodes(way: DataFrame) -> DataFrame:
    """One row a node; the run fails if two different prefixes ever had one digest."""
    same = lambda c: F.min(c) == F.max(c)
    nodes = way.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.min("bytes").alias("bytes"), F.max("last").alias("ended"),
        (same("depth") & same("q1") & same("q2") & same("bytes") & same("word")).alias("fine"))
    fine = F.when(~F.col("fine"), F.raise_error(F.lit("two prefixes have one digest")).cast("boolean")).otherwise(F.lit(True))
    return nodes.where(fine).drop("fine")


# ---------------------------------------------------------------- minimal perfect hash

class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests with the digest of every slot.

    A level is a bit array of about twice as many places as digests are left. Digests alone in their place set its bit;
    the rest go on to the next level. The slot is the number of set bits before, over all levels.
    """

    def __init__(self, p1: np.ndarray, p2: np.ndarray):
        left = np.arange(len(p1))
        self.levels: list[tuple[int, np.ndarray]] = []
        at, base = np.zeros(len(p1), np.int64), 0
        while len(left):
            size = 2 * len(left) + 1
            place = self._place(p1[left], p2[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base  # the slot of a set bit
            self.levels.append((size, np.where(alone, rank, -1)))
            good = alone[place]
            at[left[good]] = rank[place[good]]
            base += int(alone.sum())
            left = left[~good]
        self.slots = at
        self.p1, self.p2 = np.zeros(len(p1), np.int64), np.zeros(len(p1), np.int64)
        self.p1[at], self.p2[at] = p1, p2

    @staticmethod
    def _place(p1: np.ndarray, p2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = C.mix(p1.view(np.uint64) + C.U64(level) * C.U64(0x9E3779B97F4A7C15)) ^ p2.view(np.uint64)
        return (C.mix(mixed) % C.U64(size)).astype(np.int64)

    def find(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Slots of the digests, -1 for those that the table does not hold."""
        out = np.full(len(p1), -1, np.int64)
        left = np.arange(len(p1))
        for level, (size, ranks) in enumerate(self.levels):
            slot = ranks[self._place(p1[left], p2[left], level, size)]
            out[left] = slot
            left = left[slot < 0]
        hit = np.flatnonzero(out >= 0)
        wrong = (self.p1[out[hit]] != p1[hit]) | (self.p2[out[hit]] != p2[hit])
        out[hit[wrong]] = -1
        return out


TOTALS = "p1 long, p2 long, q1 long, q2 long, conv long, depth long, inside boolean, parent long, n long, children long, leaves long, saved long"


def _accumulate(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of one shard's nodes. Rows with ``carried`` are sums that subtrees below hand to the node (p1, p2)."""
    carried = frame["carried"].to_numpy(bool)
    node = {c: frame[c].to_numpy(np.int64)[~carried] for c in (*NODE, "q1", "q2", "conv", "depth", "n", "bytes")}
    below = {c: frame[c].to_numpy(np.int64)[carried] for c in (*NODE, "children", "leaves", "saved")}
    table, count = SlotTable(node["p1"], node["p2"]), len(node["p1"])

    def scatter(values: np.ndarray) -> np.ndarray:
        flat = np.zeros(count, np.int64)
        flat[table.slots] = values
        return flat

    conv, depth, n, q1, q2 = (scatter(node[c]) for c in ("conv", "depth", "n", "q1", "q2"))
    parent = np.where(depth == 0, -1, table.find(q1, q2))
    saved = (n - 1) * scatter(node["bytes"])
    children = np.bincount(parent[parent >= 0], minlength=count)
    leaves = np.zeros(count, np.int64)
    to = table.find(below["p1"], below["p2"])
    for flat, name in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(flat, to, below[name])
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return pd.DataFrame({"p1": table.p1, "p2": table.p2, "q1": q1, "q2": q2, "conv": conv, "depth": depth, "inside": parent >= 0,
                         "parent": conv[np.maximum(parent, 0)], "n": n, "children": children, "leaves": leaves, "saved": saved})


def _totals(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
    """Totals of (shard, node) rows with the sums carried to them."""
    zeros = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    rows = nodes.select("shard", *NODE, "q1", "q2", "conv", "depth", "n", "bytes", *zeros("children", "leaves", "saved"), F.lit(False).alias("carried"))
    if below is not None:
        rows = rows.union(below.join(nodes.select("shard", *NODE), NODE).select(
            "shard", *NODE, *zeros("q1", "q2", "conv", "depth", "n", "bytes"), "children", "leaves", "saved", F.lit(True)))
    return rows.groupBy("shard").applyInPandas(_accumulate, TOTALS)


def _handed_up(tops: DataFrame) -> DataFrame:
    """What the tops of units and bands add to their parents."""
    return tops.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


# ---------------------------------------------------------------- endings

def ending_hashes(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends) for rows (p1, p2, conv): SHA-256 of each node's conv ids, ascending, joined by commas; one pass over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            p1, p2, conv = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1).tolist(), len(p1)]
            done: list[tuple[int, int, str]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, ids = (int(p1[a]), int(p2[a])), ",".join(map(str, conv[a:b].tolist()))
                if key == now:
                    state.update(("," + ids).encode())
                else:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], [*NODE, "ends"])

    parts = C.partitions(ends.sparkSession)
    return ends.repartition(parts, *NODE).sortWithinPartitions(*NODE, "conv").mapInArrow(run, "p1 long, p2 long, ends string")


# ---------------------------------------------------------------- the trie

def node_totals(way: DataFrame, limit: int | None = None, band: int | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``way``: a staged table as :func:`paths` makes it. ``limit``: members of the largest node that is not heavy.
    """
    spark, band = way.sparkSession, band or BAND
    nodes = C.stage(checked_nodes(way), "nodes")
    shared = F.when(F.col("n") > 1, F.col("depth"))
    size = nodes.agg(F.sum("n").alias("rows"), F.count(shared).alias("shared"), F.max(shared).alias("deepest")).first()
    # a heavy node has over ``limit`` rows of its own, so there are at most HEAVY of them
    limit = limit or max(LIMIT, (size["rows"] or 0) // HEAVY)
    heavy = nodes.where(F.col("n") > limit)
    heavy_names = C.stage(heavy.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("of")), "heavy")

    # tails: what lies below a conversation's first node of its own needs no table
    singles = nodes.where("n = 1")
    heads = singles.groupBy("conv").agg(F.min("depth").alias("first"))
    singles = singles.join(heads, "conv").withColumn("head", F.col("depth") == F.col("first"))
    worked = nodes.where((F.col("n") > 1) & (F.col("n") <= limit)).union(singles.where("head").select(*nodes.columns))
    # the top of a conversation's unit: its first node that is not heavy (the root, or a child of a heavy node)
    of_heavy = F.broadcast(heavy_names.select("q1", "q2", F.lit(True).alias("under")))  # at most HEAVY rows
    unit = (way.join(F.broadcast(heavy_names.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"))), NODE, "left_anti")
            .join(of_heavy, ["q1", "q2"], "left").where("depth = 0 or under").select("conv", F.xxhash64(*NODE).alias("unit")))
    shards = max(C.partitions(spark), -(-size["shared"] // SHARD_NODES))
    light = C.stage(worked.join(unit, "conv").withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int"))
                    .withColumn("band", F.floor((F.greatest("depth", F.lit(1)) - 1) / band).cast("int")), "light")
    found, up = [], None
    for b in range((size["deepest"] or 0) // band, -1, -1):  # one band unless shared prefixes are very deep
        here = light.where(F.col("band") == b)
        part = C.stage(_totals(here, up), "band")
        found.append(part)
        more = _handed_up(part.where("not inside and depth > 0"))
        if up is not None:  # sums for nodes further up
            more = (more.union(up.join(here.select(*NODE), NODE, "left_anti"))
                    .groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]))
        up = C.stage(more, "handed_up")
    found.append(C.stage(_totals(heavy.withColumn("shard", F.lit(0)), up), "heavy_totals"))  # at most HEAVY nodes
    totals = found[0]
    for more in found[1:]:
        totals = totals.union(more)

    # parents in another table: heavy nodes or, with several bands, nodes of the band above
    above = F.broadcast(heavy_names)
    if len(found) > 2:
        above = heavy_names.union(light.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("of")))
    totals = totals.join(above, ["q1", "q2"], "left").withColumn(
        "parent", F.when(F.col("inside"), F.col("parent")).when(F.col("depth") > 0, F.col("of")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tabled = totals.join(ending_hashes(way.where("last").select(*NODE, "conv")), NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        # a head's only child is the next node of its conversation, if that goes on
        F.when((F.col("n") == 1) & F.col("ends").isNull(), one).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"))
    tails = singles.where("not head").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("ended"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("ended"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return tabled.union(tails)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                limit: int | None = None, band: int | None = None) -> DataFrame:
    """The nodes of the trie of the conversations as they are."""
    C.prepare(df.sparkSession)
    turns = numbered(df, conv_col, turn_col, role_col, text_col)
    way = C.stage(paths(turns, turns.select("conv").distinct()), "paths")
    C.unstage(turns)
    return node_totals(way, limit, band)


def rebuilt_trie(df: DataFrame, limit: int | None = None, band: int | None = None) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations (conv_id, turn, role, text)."""
    C.prepare(df.sparkSession)
    turns = numbered(df)
    way = C.stage(paths(*rebuilt(turns)), "paths")
    C.unstage(turns)
    return node_totals(way, limit, band)


def op12_mph_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(C.read(spark, sf_dir, "conversations"))


QUERIES = {"op12_mph_prefix_trie": op12_mph_prefix_trie}


#: CRC-32 of a conversation's decimal name, bit by bit: -1 stands for a shift.
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

ORACLE = {"op12_mph_prefix_trie": f"""
WITH t AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS place, digest, bytes FROM (
    SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
      octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
k AS MATERIALIZED (
  SELECT c, c - c % {FAMILY} AS base, {_CRC} % {SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS MATERIALIZED (
  SELECT k.c, t.place AS d, t.digest, t.bytes FROM k JOIN t ON t.c = k.base AND t.place <= k.h
  UNION ALL
  SELECT k.c, t.place - k.h + least(k.h, coalesce(b.n, 0)), t.digest, t.bytes
  FROM k JOIN t ON t.c = k.c AND t.place > k.h LEFT JOIN size b ON b.c = k.base),
w AS MATERIALIZED (
  SELECT c, d, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS node, bytes,
    d = max(d) OVER (PARTITION BY c) AS last FROM r
  UNION ALL SELECT k.c, 0, '', 0, k.c NOT IN (SELECT c FROM r) FROM k),
way AS MATERIALIZED (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM w),
nodes AS MATERIALIZED (
  SELECT node, d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends
  FROM way GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS MATERIALIZED (
  SELECT v.*, p.c AS parent_c, coalesce(kids.n_children, 0) AS n_children
  FROM nodes v LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN kids ON kids.node = v.node),
below AS (
  SELECT way.node, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
  FROM full_nodes v JOIN way ON way.c = v.c AND way.d <= v.d GROUP BY way.node)
SELECT v.c AS conv_id, v.d AS depth, v.parent_c AS parent_conv_id, v.n AS n_convs, v.n_children,
  b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM full_nodes v JOIN below b ON b.node = v.node
"""}

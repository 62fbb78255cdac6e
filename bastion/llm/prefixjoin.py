"""Operator 3: n-gram Jaccard join by grouped prefixes.

A text's set holds the hashes of its distinct 5-word shingles. Two texts link when
100 * |intersection| >= 75 * |union|; the result is each text's connected component. The steps:

1. Equal sets fall into one class (a 64-bit sum over the set and its size).
2. Survivors. Of two partners' shingles in hash order, the first n - ceil(0.75 n) + n // 4 of each hold at
   least a quarter of the smaller set in common. Only these are exchanged, as packed arrays (32 hash bits
   and a 16-bit place in their chunk), at most one entry per shingle and chunk, so a shingle of very many
   texts costs one entry per chunk; every chunk gets back which of its entries were met elsewhere. A text
   that shares fewer than so many with others has no partner. Most texts end here.
3. Grouped prefix join. The survivors' shingles are ordered by frequency, rarest first. Partners share a
   shingle in the first n - ceil(0.75 n) + 1 of each. Shingles of one class only match nothing and are left
   out. Classes with equal prefixes and sizes collapse into one group. Groups that share a prefix shingle
   and whose sizes may reach 0.75 (size bands of ratio 4/3, neighbours included) are packed into one cluster; edges
   lead to one hub per shingle and band, never between all pairs.
4. Filter group pairs. A cluster of at most BLOCK members is one task, which compares the members that share shingles. A larger
   one may be a chain whose ends have nothing in common, so it is taken apart: the groups of each prefix shingle of at most SPARSE
   members are paired, and a pair stays only if its sizes and the places of the shingle in both orders leave room for
   enough common ones. Groups that share a shingle of more members form dense clusters of their own (through hubs again).
5. Expand and verify. Pairs are expanded to their members and their whole sets compared exactly. Members of a dense cluster are
   compared by incidence products; those of over BLOCK members are cut into blocks that are compared pairwise, a task each. When
   only components are asked for, members of large dense clusters first meet a few hub members each, and members already
   linked by these are not compared with one another; when links are counted, all pairs of a dense cluster are compared.

Links are found by 64-bit hashes of shingles; but for hash collisions the components and the numbers of links
are exact. Spanning links and one sum per member leave a task; nothing is collected to the driver.

Defined cases: null text, empty text and text without words have the empty set, n_shingles 0 and their
own id as component; fewer than 5 words make one shingle, the whole sequence; rows with null ids take
part, the component's name is the smallest non-null id (null if there is none); rows with equal ids are
judged by their own texts; repeated rows stay rows; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Similarity in percent.
PERCENT = 75
#: Shingles (with repeats between texts) and texts of a chunk in step 2.
CHUNK_SHINGLES, CHUNK_TEXTS = 1 << 21, 60000
#: Members of a cluster that are compared in one task; a set of more than LARGE shingles counts as several.
BLOCK, LARGE = 1024, 512
#: Members of a prefix shingle whose pairs are formed one by one.
SPARSE = 32
#: Hub members that every member of a larger cluster meets first.
HUBS = 6
NO_REPLY = 0xFFFF
#: Bits of a sieve at most (8 MB).
SIEVE_BITS = 1 << 26


def need(n):
    """Common shingles that a set of n must share at least: ceil(0.75 n)."""
    return (PERCENT * n + 99) // 100


def spare(n):
    """Common shingles that step 2 asks of a set of n, and sends beyond the part that may differ."""
    return np.maximum(1, n // 4)


def sent(n):
    """How many of a set's n shingles, in hash order, step 2 sends: two linked sets share the ``spare`` smallest common ones there."""
    return n - need(n) + spare(n)


def node_of(tokens: np.ndarray) -> int:
    """Order-free 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(C.mix(tokens ^ C.U64(0x5851F42D4C957F2D)), dtype=C.U64) + C.U64(len(tokens)) * C.U64(0x9E3779B97F4A7C15)
    return int(np.int64(total.astype(np.int64)))


def profiles(rows: DataFrame) -> DataFrame:
    """(id, mark, n, node) of every row of (id, text): size and name of its set; ``mark`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for _, _, data, offs in C.text_groups(batch.column(1)):
                for s in C.sets_of(data, offs):
                    sizes.append(len(s))
                    nodes.append(node_of(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())],
                                             ["id", "mark", "n", "node"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "mark").mapInArrow(run, f"id {kind}, mark long, n long, node long")


# ---------------------------------------------------------------- step 2

def _entries(texts: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, a, b): packed shingle entries by hash range, and one row per chunk that describes its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        known: list[tuple[int, int]] = []  # (node, n) of each text
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            # named after its content as well: replies to a chunk that a rerun has made differently find no description
            named = np.array([task, seq, *(node for node, _ in known)], dtype=np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                chunk = int(np.add.reduce(C.mix(named + C.mix(np.arange(len(named), dtype=C.U64)))).view(np.int64))
            seq += 1
            sizes = np.array([len(s) for s in held], dtype=np.int64)
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            start = np.flatnonzero(first)
            shared = np.repeat(np.diff(np.append(start, len(tokens))) > 1, np.diff(np.append(start, len(tokens))))
            local = np.bincount(owner[shared], minlength=len(held)).astype(np.int32)
            entry, reply = tokens[start], np.where(shared[start], NO_REPLY, owner[start]).astype(np.uint16)
            # the low bits deal entries evenly: the high ones are small by choice of the sent part
            part = ((entry & C.U64(0xFFFF)) * C.U64(parts)) >> C.U64(16)
            order = np.argsort(part, kind="stable")
            entry, reply = entry[order], reply[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=C.U64))
            low = ((entry >> C.U64(16)) & C.U64(0xFFFFFFFF)).astype(np.uint32)
            some = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            home = int(C.mix(np.array([chunk], np.int64).view(C.U64))[0] % C.U64(parts))
            return pa.RecordBatch.from_arrays([
                pa.array([*some, home], pa.int32()), pa.array([chunk] * (len(some) + 1), pa.int64()),
                pa.array([*(low[cuts[p]:cuts[p + 1]].tobytes() for p in some), np.array(known, dtype=np.int64).T.tobytes()], pa.binary()),
                pa.array([*(reply[cuts[p]:cuts[p + 1]].tobytes() for p in some), local.tobytes()], pa.binary()),
                pa.array([*[False] * len(some), True])], ["part", "chunk", "a", "b", "about"])

        for batch in batches:
            for _, _, data, offs in C.text_groups(batch.column(0)):
                for s in C.sets_of(data, offs):
                    if len(s):
                        held.append(s[:sent(len(s))])
                        known.append((node_of(s), len(s)))
                        size += len(held[-1])
                    if size >= CHUNK_SHINGLES or len(held) >= CHUNK_TEXTS:
                        yield flush()
                        held, known, size = [], [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "part int, chunk long, a binary, b binary, about boolean")


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Entries of one hash range: for each chunk the places of its texts whose shingles other chunks have too."""
    about = frame[frame["about"]]
    frame = frame[~frame["about"]]
    out = [about[["chunk", "a", "b", "about"]]]
    if len(frame):
        keys = [np.frombuffer(x, np.uint32) for x in frame["a"]]
        chunk = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, reply = np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint16) for x in frame["b"]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        met = np.zeros(len(key), bool)
        met[1:] |= same
        met[:-1] |= same
        back = order[met]
        back = np.sort(back[reply[back] != NO_REPLY])
        cuts = np.searchsorted(chunk[back], np.arange(len(keys) + 1))
        names = frame["chunk"].to_numpy()
        got = [(names[k], reply[back[cuts[k]:cuts[k + 1]]].tobytes()) for k in range(len(keys)) if cuts[k + 1] > cuts[k]]
        out.append(pd.DataFrame({"chunk": np.array([g[0] for g in got], np.int64), "a": [g[1] for g in got], "b": [b""] * len(got), "about": [False] * len(got)}))
    return pd.concat(out, ignore_index=True)


def _survive(frame: pd.DataFrame) -> pd.DataFrame:
    """Texts of one chunk that share enough of the shingles they sent: (node, n)."""
    about = frame[frame["about"]]
    if not len(about):
        raise RuntimeError("the input changed between two attempts of a task: stage it before the join")
    nodes, sizes = np.frombuffer(about["a"].iloc[0], np.int64).reshape(2, -1)
    shared = np.frombuffer(about["b"].iloc[0], np.int32).astype(np.int64)
    for reply in frame[~frame["about"]]["a"]:
        shared = shared + np.bincount(np.frombuffer(reply, np.uint16), minlength=len(shared))
    keep = shared >= spare(need(sizes))
    return pd.DataFrame({"node": nodes[keep], "n": sizes[keep]})


def survivors(texts: DataFrame) -> DataFrame:
    """Distinct (node, n) of classes that may have a partner."""
    parts = 4 * C.partitions(texts.sparkSession)  # several ranges a task, so that hashing deals them evenly
    met = (_entries(texts, parts).groupBy("part")
           .applyInPandas(_meet, "chunk long, a binary, b binary, about boolean"))
    return met.groupBy("chunk").applyInPandas(_survive, "node long, n long").distinct()


def sieve(keys: DataFrame) -> DataFrame:
    """(word, bits): a bit for each hash of the long column ``key``, at most SIEVE_BITS / 64 rows.

    About 16 bits a key up to that bound; beyond it more keys share a bit, and more rows pass for :func:`may_hold`.
    """
    bits = min(SIEVE_BITS, 1 << max(10, (16 * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64("key", F.lit("sieve")), F.lit(bits))
    return keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"), F.max(F.lit(bits)).alias("of"))


def may_hold(rows: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """``rows`` with ``__llm_key`` and ``__llm_maybe``: false only if the key is none of the sieve's. No shuffle of the rows."""
    head = kept.agg(F.max("of")).first()[0] or 64
    table = kept.select(F.col("word").alias("__llm_word"), F.col("bits").alias("__llm_bits"))
    place = F.pmod(F.xxhash64("__llm_key", F.lit("sieve")), F.lit(head))
    return (rows.withColumn("__llm_key", key).withColumn("__llm_place", place).withColumn("__llm_word", F.shiftright("__llm_place", 6))
            .join(F.broadcast(table), "__llm_word", "left")  # at most SIEVE_BITS / 64 rows
            .withColumn("__llm_maybe", F.coalesce(F.expr("(shiftright(__llm_bits, cast(__llm_place & 63 as int)) & 1) = 1"), F.lit(False)))
            .drop("__llm_place", "__llm_word", "__llm_bits"))


def survivor_sets(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """(node, n, tokens) of the surviving classes, from one text of each. ``alive``: (id, mark) of those texts."""
    chosen = C.stage(alive.select(F.xxhash64("id", "mark").alias("key"), F.col("id").alias("__llm_id"), F.col("mark").alias("__llm_mark")), "chosen")
    # only texts that pass the sieve are dealt by their key
    maybe = may_hold(rows, F.xxhash64("id", "mark"), sieve(chosen)).where("__llm_maybe")
    texts = maybe.join(chosen, (F.col("__llm_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("__llm_id")) & (
        F.col("mark") == F.col("__llm_mark")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in C.text_groups(batch.column(0)):
                sets = [s for s in C.sets_of(data, offs) if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return texts.mapInArrow(run, "node long, n long, tokens array<long>").dropDuplicates(["node", "n"])


# ---------------------------------------------------------------- step 3

def _hub_edges(index: DataFrame) -> DataFrame:
    """(a, b) edges of rows (group, band, token): to one hub per shingle and band, and between the hubs of neighbour bands."""
    hubs = index.groupBy("token", "band").agg(F.min("group").alias("hub"), F.count("*").alias("m"))
    inside = (index.join(hubs.where("m > 1"), ["token", "band"]).where("group <> hub")
              .select(F.col("group").alias("a"), F.col("hub").alias("b")))
    # partners' sizes differ by 4/3 at most, so their bands are equal or neighbours
    next_band = hubs.select("token", (F.col("band") - 1).alias("band"), F.col("hub").alias("b"))
    across = hubs.join(next_band, ["token", "band"]).select(F.col("hub").alias("a"), "b").where("a <> b")
    return inside.union(across)


def clusters(sets: DataFrame, sparse: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, n, cluster) of classes whose clusters are compared whole, and candidate pairs (x, y) of classes besides."""
    sparse = sparse or SPARSE
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    # per class its matchable shingles, rarest first; at most a text's own number
    ranked = (tokens.join(often, "token").groupBy("node", "n")
              .agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("known")))
    alone = F.col("n") - F.size("known")  # shingles of this class only come first in its order
    first = F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100) + 1 - alone
    prefix = (ranked.select("node", "n", "known", alone.alias("alone"), first.cast("int").alias("most")).where("most > 0")
              .select("node", "n", "alone", F.transform(F.slice("known", 1, F.col("most")), lambda x: x["token"]).alias("prefix")))
    prefix = C.stage(prefix.withColumn("group", F.xxhash64(F.array_sort("prefix"), "n")), "prefix")
    # classes with equal prefixes and sizes are one group
    groups = prefix.groupBy("group").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.count("*").alias("m"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + F.lit(1e-9)).cast("int")
    index = groups.select("group", band.alias("band"), F.explode("prefix").alias("token"))
    own = groups.where("m > 1").select(F.col("group").alias("a"), F.col("group").alias("b"))
    label = C.connected_components(_hub_edges(index).union(own).distinct())
    members = C.stage(prefix.select("node", "n", "group").join(label, prefix["group"] == label["node"])
                      .select(prefix["node"], prefix["n"], "group", label["component"].alias("cluster")), "clusters")
    C.unstage(label)
    load = F.sum(F.greatest(F.lit(1.0), F.col("n") / LARGE))
    large = members.groupBy("cluster").agg(load.alias("load")).where(F.col("load") > BLOCK).select("cluster")
    taken = C.stage(members.join(large, "cluster"), "large_clusters")
    if taken.isEmpty():
        none = taken.select(F.col("node").alias("x"), F.col("node").alias("y"))
        return members.select("node", "n", "cluster"), none
    out = _taken_apart(prefix, members, taken, band, sparse)
    C.unstage(prefix)
    return out


def _taken_apart(prefix: DataFrame, members: DataFrame, taken: DataFrame, band: Column, sparse: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`clusters`, with the members of large clusters (``taken``) in dense clusters and candidate pairs."""
    some = prefix.join(taken.select("node", "n", "cluster"), ["node", "n"])
    posted = C.stage(some.select("node", "n", "group", band.alias("band"), F.posexplode("prefix").alias("at", "token"), "alone")
                     .select("node", "n", "group", "band", "token", (F.col("at") + F.col("alone")).alias("at")), "postings")
    counts = posted.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    dense = posted.join(counts.where(F.col("m") > sparse).select("token"), "token").select("group", "band", "token").distinct()
    several = taken.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select(F.col("group").alias("a"), F.col("group").alias("b"))
    label = C.connected_components(_hub_edges(dense).union(several).distinct())
    whole = members.join(taken.select("cluster").distinct(), "cluster", "left_anti").select("node", "n", "cluster").union(
        taken.join(label.withColumnRenamed("node", "group"), "group").select("node", "n", F.col("component").alias("cluster")))
    # at most ``sparse`` members of a shingle meet in one row
    lists = (posted.join(counts.where(F.col("m") <= sparse).select("token"), "token")
             .join(label.withColumnRenamed("node", "group"), "group", "left")
             .groupBy("token").agg(F.collect_list(F.struct("node", "n", "at", "component")).alias("have")))

    def fits(p: Column, q: Column) -> Column:
        shared = F.ceil(PERCENT * (p["n"] + q["n"]) / F.lit(100.0 + PERCENT) - F.lit(1e-9))  # common shingles of a linked pair
        room = F.least(p["n"] - p["at"], q["n"] - q["at"])
        return ((p["node"] < q["node"]) & (100 * F.least(p["n"], q["n"]) >= PERCENT * F.greatest(p["n"], q["n"])) & (room >= shared)
                & ~F.coalesce(p["component"] == q["component"], F.lit(False)))

    near = F.flatten(F.transform("have", lambda p: F.transform(F.filter("have", lambda q: fits(p, q)), lambda q: F.struct(
        p["node"].alias("x"), q["node"].alias("y")))))
    pairs = C.stage(lists.select(F.explode(near).alias("p")).select("p.x", "p.y").distinct(), "group_pairs")
    return whole, pairs


# ---------------------------------------------------------------- step 5

def _forest(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph on 0 .. count - 1 with links a[i] - b[i]."""
    parent = list(range(count))
    keep = []

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
            if len(keep) == count - 1:
                break
    return a[keep], b[keep]


def common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections between two blocks of sets (one block: with itself), by incidence products."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[code] > 1  # a shingle of one set meets nothing
    rank = np.cumsum(times > 1) - 1
    owner, column = np.repeat(np.arange(len(sets)), sizes)[keep], rank[code[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m = len(left), len(right) if right else len(left)
    total = int((times > 1).sum())
    often = np.diff(np.searchsorted(column, np.arange(total + 1)))
    if (often.astype(np.float64) ** 2).sum() < 0.05 * total * len(sets) + 1e5:  # few members share each shingle: count the pairs that do
        return _counted(owner, column, often, n, m, bool(right))
    out = np.zeros((n, m), dtype=np.float32)
    width = max(1, min(4096, total))
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        matrix = np.zeros((len(sets), width), dtype=np.float32)
        matrix[owner[lo:hi], column[lo:hi] - at] = 1
        out += matrix[:n] @ (matrix[n:] if right else matrix).T
    return np.rint(out).astype(np.int64)


def _counted(owner: np.ndarray, column: np.ndarray, often: np.ndarray, n: int, m: int, two: bool) -> np.ndarray:
    """Intersection sizes from the shingles' member lists, pair by pair."""
    out = np.zeros((n, m), dtype=np.int64)
    begin = np.cumsum(often) - often
    within = np.arange(len(owner)) - begin[column]  # place in the shingle's list
    for step in range(1, int(often.max(initial=0))):
        at = np.flatnonzero(within + step < often[column])
        a, b = np.minimum(owner[at], owner[at + step]), np.maximum(owner[at], owner[at + step])
        if two:
            cross = (a < n) & (b >= n)
            np.add.at(out, (a[cross], b[cross] - n), 1)
        else:
            np.add.at(out, (a, b), 1)
            np.add.at(out, (b, a), 1)
    return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets between two blocks, or within one."""
    shared = common(left, right)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (right or left)])[None, :]
    hit = 100 * shared >= PERCENT * (a + b - shared)
    return np.nonzero(hit if right else np.triu(hit, 1))


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """Between the members of one task, all of side 0 with one another or sides 0 and 1: spanning links (a, b, null) and,
    of each linked member, how many rows its partners here stand for (a, null, links)."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    alone = bool(frame["self"].iloc[0])
    if not alone and not (len(left) and len(right)):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": pd.array([], "Int64"), "links": pd.array([], "Int64")})
    sets = lambda f: [np.asarray(x) for x in f["tokens"]]
    a, b = links(sets(left), None if alone else sets(right))
    both = left if alone else pd.concat([left, right])
    b = b if alone else b + len(left)
    nodes, copies = both["node"].to_numpy(), both["copies"].to_numpy()
    degree = np.zeros(len(both), np.int64)
    np.add.at(degree, a, copies[b])
    np.add.at(degree, b, copies[a])
    some = np.flatnonzero(degree)
    a, b = _forest(a, b, len(both))
    return pd.DataFrame({"a": np.concatenate([nodes[a], nodes[some]]),
                         "b": pd.array([*nodes[b].tolist(), *[None] * len(some)], "Int64"),
                         "links": pd.array([*[None] * len(a), *degree[some].tolist()], "Int64")})


def _hub_links(big: DataFrame) -> DataFrame:
    """Links of the members of large clusters with a few hub members of their cluster, exact."""
    salts = C.partitions(big.sparkSession)
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node"))).alias(f"h{k}") for k in range(HUBS)]
    picked = (big.groupBy("cluster").agg(*draws)
              .select("cluster", F.explode(F.array_distinct(F.array(*[F.col(f"h{k}")["node"] for k in range(HUBS)]))).alias("node")))
    hubs = (big.join(picked, ["cluster", "node"]).select("cluster", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    met = (big.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(salts)).cast("int"))
           .join(hubs, ["cluster", "salt"]).where("node <> hub")
           .withColumn("shared", F.size(F.array_intersect("tokens", "hub_tokens"))))
    return met.where(100 * F.col("shared") >= PERCENT * (F.col("n") + F.col("hub_n") - F.col("shared"))).select(
        F.col("node").alias("a"), F.col("hub").alias("b"))


def pair_links(sets: DataFrame, pairs: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(a, b, null) of linked candidate pairs; with ``classes`` also (a, null, links) for both ends."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("shared", F.size(F.array_intersect("tx", "ty")))
    hit = met.where(100 * F.col("shared") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("shared"))).select("x", "y")
    none = F.lit(None).cast("long")
    out = hit.select(F.col("x").alias("a"), F.col("y").alias("b"), none.alias("links"))
    if classes is None:
        return out
    copies = classes.select(F.col("node").alias("b"), "copies")
    both = hit.select(F.col("x").alias("a"), F.col("y").alias("b")).union(hit.select(F.col("y").alias("a"), F.col("x").alias("b")))
    return out.union(both.join(copies, "b").select("a", none, F.col("copies").alias("links")))


def verified_links(sets: DataFrame, members: DataFrame, classes: DataFrame | None = None, besides: DataFrame | None = None) -> DataFrame:
    """Links (a, b, null) between classes whose closure is that of all links within clusters and among the candidate pairs (x, y) ``besides``.

    With ``classes`` (node, n, copies) all pairs of a cluster are compared, and rows (a, null, links) hold parts of the
    number of rows that a class is linked with, its own not counted.
    """
    load = F.ceil(F.sum(F.greatest(F.lit(1.0), F.col("n") / LARGE))).alias("m")
    sized = members.groupBy("cluster").agg(F.count("*").alias("count"), load).where("count > 1").drop("count")
    whole = sets.join(members, ["node", "n"]).join(sized, "cluster")
    whole = C.stage(whole.withColumn("copies", F.lit(1).cast("long")) if classes is None
                    else whole.join(classes.select("node", "n", "copies"), ["node", "n"]), "members")
    big = whole.where(F.col("m") > BLOCK)
    early = label = None
    if classes is None:
        early = C.stage(_hub_links(big), "hub_links")
        label = C.connected_components(early)
        # blocks: members whom the hubs linked lie together by component, all others in mixed blocks (component null)
        placed = big.join(label.select("node", "component"), "node", "left")
    else:  # a member's links with members of its own component count as well
        placed = big.withColumn("component", F.lit(None).cast("long"))
    blocks = placed.groupBy("cluster", "component").agg(load).select(
        "cluster", "component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    of = blocks.select(F.col("cluster").alias("__c"), F.col("component").alias("__k"), "blocks")
    placed = C.stage(placed.join(of, (F.col("cluster") == F.col("__c")) & F.col("component").eqNullSafe(F.col("__k")))
                     .select("cluster", "node", "n", "copies", "tokens", F.xxhash64(
                         "cluster", "component", F.pmod(F.xxhash64("node", F.lit("block")), "blocks")).alias("block")), "placed")
    listed = blocks.select("cluster", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(
        "cluster", "component", F.xxhash64("cluster", "component", F.col("k").cast("long")).alias("block"))
    other = listed.select("cluster", F.col("component").alias("component2"), F.col("block").alias("block2"))
    pairs = (listed.join(other, "cluster").where("block <= block2")
             .where(~F.coalesce(F.col("component") == F.col("component2"), F.lit(False)))
             .select("cluster", "block", "block2", F.xxhash64("cluster", "block", "block2").alias("task"), (F.col("block") == F.col("block2")).alias("self")))
    sides = pairs.select("task", "self", "cluster", "block", F.lit(0).alias("side")).union(
        pairs.where(~F.col("self")).select("task", "self", "cluster", F.col("block2").alias("block"), F.lit(1).alias("side")))
    tasks = placed.join(sides, ["cluster", "block"]).select("task", "self", "side", "node", "copies", "tokens").union(
        whole.where(F.col("m") <= BLOCK).select(F.col("cluster").alias("task"), F.lit(True).alias("self"), F.lit(0).alias("side"), "node", "copies", "tokens"))
    found = tasks.groupBy("task").applyInPandas(_verify, "a long, b long, links long")
    if besides is not None:
        found = found.union(pair_links(sets, besides, classes))
    out = C.stage(found if early is None else early.select("a", "b", F.lit(None).cast("long").alias("links")).union(found), "links")
    for used in (whole, early, label, placed):
        C.unstage(used)
    return out


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(id, mark, n_shingles, component_id, first) of every row; component_id is the smallest id reachable by links.

    ``count_links`` adds ``n_links``: how many other rows the row is linked with, rows of equal sets included; rows
    without words have none. It takes a comparison of all pairs of a cluster.

    ``mark`` is the text's 64-bit hash. ``first`` is true for the rows of the component's first text: smallest
    id, nulls last, then smallest mark. Only repeated rows, equal in both, are first together.
    """
    spark = df.sparkSession
    C.prepare(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    profile = C.stage(profiles(rows), "profiles")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("lead")
    classes = C.stage(profile.where("n > 0").groupBy("node", "n").agg(lead, F.count("*").alias("copies")), "classes")
    alive = survivors(rows.select("text"))
    sets = C.stage(survivor_sets(rows, classes.join(alive, ["node", "n"]).select("lead.id", "lead.mark")), "sets")
    found, pairs = clusters(sets)
    edges = verified_links(sets, found, classes if count_links else None, pairs)
    label = C.connected_components(edges)  # rows without b are no links
    if count_links:
        degree = edges.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        label = C.stage(label.join(degree, "node", "left"), "labels")
    for used in (sets, found, edges):
        C.unstage(used)
    named = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("lead").alias("head"))
    links_of = [(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")] if count_links else []
    named = named.join(heads, "component").select("node", "n", "head", *links_of)
    linked = (profile.where("n > 0").join(named, ["node", "n"])
              .select("id", "mark", F.col("n").alias("n_shingles"), F.col("head.id").alias("component_id"),
                      (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark"))).alias("first"),
                      *["n_links"] * count_links))
    return linked.union(profile.where("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"), F.lit(True),
                                                      *[F.lit(0).cast("long")] * count_links))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component; rows without words stay as they are.

    Rows that a sieve of the keys to be dropped tells apart for certain stay where they lie; only the others are dealt by
    their key and looked up.
    """
    found = near_components(df, id_col, text_col).select(
        F.xxhash64("id", "mark").alias("key"), F.col("id").alias("__llm_id"), F.col("mark").alias("__llm_mark"), "first",
        (F.col("n_shingles") == 0).alias("__llm_none"))
    found = C.stage(found, "found")
    # keys with a row that must go: not of the first text, or repeated rows of it
    going = found.where("not __llm_none").groupBy("key").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("not first or n > 1")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = may_hold(df.withColumn("__llm_text", mark), F.xxhash64(F.col(id_col), F.col("__llm_text")), sieve(going))
    first = found.where("first").drop("first").distinct()
    met = rows.where("__llm_maybe").join(first, F.col("__llm_key") == F.col("key")).where(
        F.col(id_col).eqNullSafe(F.col("__llm_id")) & (F.col("__llm_text") == F.col("__llm_mark")))
    # repeated rows of the first text: one stays; the join has dealt the rows by the key already
    rank = Window.partitionBy("__llm_key", "__llm_id", "__llm_mark").orderBy(F.lit(0))
    met = met.withColumn("__llm_k", F.row_number().over(rank)).where("__llm_k = 1 or __llm_none")
    return rows.where("not __llm_maybe").select(*df.columns).union(met.select(*df.columns))


def op3_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(C.read(spark, sf_dir, "documents"), count_links=True)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


QUERIES = {"op3_grouped_prefix_join": op3_grouped_prefix_join}

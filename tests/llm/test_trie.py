import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from bastion.llm import trie as T

from .helpers import SF, table

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows, rebuild=True):
    """The contract in plain Python: sorted tuples of a node."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    turns = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in turns.items()}
    convs = turns
    if rebuild:
        convs = {}
        for c, own in turns.items():
            h = zlib.crc32(str(c).encode()) % 9
            convs[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    total = {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves = sum(total[k][0] for k in kids) or 1
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(total[k][1] for k in kids)
        total[node] = (leaves, saved)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[7]))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0], r[7]))


def chats(seed, n, deep=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for d in range(rng.randrange(1, deep + 1)):
            rows.append((c, d, ("user", "assistant")[d % 2], rng.choice(["hi", "yes é", ""]) if rng.random() < 0.8 else f"own {c}"))
    return rows


def test_driver_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    assert collected(T.op12_mph_prefix_trie(spark, SF)) == plain(rows)


@pytest.mark.parametrize("limit,band", [(None, None), (5, None), (40, 2), (1000, 1)])
def test_limits_and_bands_against_plain(spark, limit, band):
    """Hot first turns cut below heavy nodes; deep prefixes in several bands."""
    rows = chats(1, 150) + [(c, d, "user", f"same {d}") for c in range(200, 230) for d in range(9 + c % 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(T.rebuilt_trie(df, limit, band)) == plain(rows)


def test_plain_conversations(spark):
    rows = chats(4, 60)
    assert collected(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), limit=7)) == plain(rows, rebuild=False)


def test_edge_cases(spark):
    from pyspark.sql import functions as F
    rows = [(1, None, "user", "a"), (1, 0, None, "b"), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"),
            (-3, 0, "user", "a"), (-3, 1, "a", "b"), (-5, 0, "u", "a"), (7, 0, "u", "ab"), (8, 0, "ua", "b"), (6, 0, "user", "long " * 200000),
            *[(c, 0, "user", "only") for c in range(10, 40)]]  # short ones of a family may end up without turns
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("depth", F.lit("x"))
    # SQL's remainder has the sign of the conversation
    want = plain([r for r in rows if r[0] is None or r[0] >= 0])
    assert collected(T.rebuilt_trie(df.where("conv_id is null or conv_id >= 0"))) == want
    assert T.rebuilt_trie(df.where("conv_id < 0")).where("depth = 0").first()["n_convs"] == 2
    assert T.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.rebuilt_trie(df.where("conv_id is null")).count() == 0
    assert collected(T.rebuilt_trie(df.where("conv_id = 6"))) == plain([r for r in rows if r[0] == 6])


def test_one_long_conversation_over_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(5, d, "user", f"t{d}") for d in range(300)] + [(6, d, "user", f"t{d}") for d in range(290)] + [(9, 0, "user", "t0")]
    random.Random(2).shuffle(rows)
    assert collected(T.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    p1, p2 = rng.integers(-2 ** 63, 2 ** 63 - 1, 5000), rng.integers(0, 4, 5000)
    p1[:40] = 7  # digests that differ in one word only
    p2[:40] = np.arange(40)
    known = T.SlotTable(p1, p2)
    assert sorted(known.slots.tolist()) == list(range(5000))
    assert (known.find(p1, p2) == known.slots).all()
    assert (known.find(p1, p2 + 100) == -1).all()  # a slot of another digest is no hit
    assert len(T.SlotTable(p1[:0], p2[:0]).find(p1[:3], p2[:3])) == 3


def test_a_shared_digest_stops_the_run(spark):
    way = spark.createDataFrame([(1, 1, 5, 6, 0, 0, 10, 3, True), (2, 1, 5, 6, 0, 0, 11, 3, True)],
                                "conv long, depth long, p1 long, p2 long, q1 long, q2 long, word long, bytes long, last boolean")
    with pytest.raises(Exception, match="one digest"):
        T.checked_nodes(way).count()

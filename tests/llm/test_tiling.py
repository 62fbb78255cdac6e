import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bastion.llm import tiling as G

from .helpers import SF, table


def hashed(text):
    return np.concatenate([h for _, _, h, _ in G.words(pa.array([text], pa.large_string()))])


def slow_tiles(doc, item, least):
    """Greedy string tiling by trying all starts: the longest unmarked match first, ties by place."""
    in_doc, in_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and not in_doc[d + k] and not in_item[i + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (d, i, k)
        if best is None:
            return out
        d, i, k = best
        in_doc[d:d + k] = in_item[i:i + k] = [True] * k
        out.append(best)


def test_tiles_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(3, 40))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 50))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(item))
            at = rng.randrange(len(doc))
            doc[at:at] = item[a:a + rng.randrange(12)]
        h = lambda s: np.array([ord(c) * 0x9E3779B97F4A7C15 % 2 ** 64 for c in s], np.uint64)
        got = G.tile(h(doc), h(item), 3)
        want = slow_tiles(doc, item, 3)
        assert [t[2] for t in got] == [t[2] for t in want]
        assert all(doc[d:d + k] == item[i:i + k] for d, i, k in got)


ITEM = " ".join(f"word{i}" for i in range(40))


def test_reordered_partial_and_clean(make_docs, spark):
    w = ITEM.split()
    texts = ["pre " + ITEM + " post", " ".join(w[20:] + ["gap"] * 30 + w[:20]).upper(), " ".join(w[:10]) + " x " + " ".join(w[12:24]),
             " ".join(w[:19]), " ".join(w[::-1]), " ".join(w[0::2]), None, "", "one two"]
    bench = spark.createDataFrame([(7, ITEM, 1), (8, "too short item", 1), (9, None, 1), (None, ITEM, 1)], "item_id long, text string, coverage int")
    df = make_docs(texts).withColumn("coverage", F.lit("x")).withColumn("item_id", F.lit(5)).withColumn("words", F.lit(1))
    got = {(r["id"], r["item_id"]): (round(r["coverage"], 3), len(r["tiles"])) for r in G.contaminated(df, bench).collect()}
    want = {0: (1.0, 1), 1: (1.0, 2), 2: (0.55, 2)}
    assert got == {(k, i): v for k, v in want.items() for i in (7, None)}
    assert sorted(r["doc_id"] for r in G.with_coverage(df, bench).where("coverage = 0.0").collect()) == [3, 4, 5, 6, 7, 8]


def test_blocks_of_the_benchmark_agree(make_docs, spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs([items[k][1] + " tail " + items[(k + 5) % 12][1] for k in range(12)])
    whole = {(r["id"], r["item_id"]) for r in G.contaminated(df, bench).collect()}
    assert whole == {(k, i) for k in range(12) for i in (k, (k + 5) % 12)}
    rows = list(G.blocks(bench, block_words=64))
    assert len(rows) == 6 and sorted(i for b in rows for i in b.ids) == list(range(12))
    assert list(G.blocks(bench.limit(0))) == [] and G.contaminated(df, bench.limit(0)).count() == 0


def test_driver_table(spark):
    bench = {r["item_id"]: hashed(r["text"]) for r in table("benchmark")}
    want = set()
    for r in table("documents"):
        doc = hashed(r["text"] or "")
        own = set(doc.tolist())
        for i, item in bench.items():
            if len(item) >= 5 and sum(x in own for x in item.tolist()) >= len(item) / 2:
                if sum(t[2] for t in G.tile(doc, item)) >= 0.5 * len(item):
                    want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in G.op10_greedy_tiling_decontamination(spark, SF).collect()}
    assert got == want


def test_millions_of_equal_words_take_bounded_memory():
    import tracemalloc
    doc, item = np.full(2_000_000, 12345, np.uint64), np.full(2000, 12345, np.uint64)
    tracemalloc.start()
    tiles = G.tile(doc, item)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(t) for t in tiles] == [(0, 0, 2000)] and peak < 500e6, peak


def test_runs_of_repeated_words_meet_on_every_diagonal():
    a, b, c = (int(G.C.mix(np.array([k], np.uint64))[0]) for k in (1, 2, 3))
    doc = np.array([a, a, a, b, a, a, a, a, b, c, a, a], np.uint64)
    item = np.array([a, a, b, a, a, a, a, b, c], np.uint64)
    assert [tuple(t) for t in G.tile(doc, item, 3)] == [(1, 0, 9)]
    assert [tuple(t) for t in G.tile(item, doc, 3)] == [(0, 1, 9)]
    assert [tuple(t) for t in G.tile(np.full(7, a, np.uint64), np.full(4, a, np.uint64), 3)] == [(0, 0, 4)]

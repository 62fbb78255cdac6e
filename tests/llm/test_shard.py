import math
import zlib

import numpy as np

from bastion.llm import shard as S

from .helpers import SF, table


def test_matrix_has_exact_margins():
    counts, sizes = [10, 0, 7, 33], [13, 13, 12, 12]
    for seed in range(50):
        m = S.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes and min(map(min, m)) >= 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    good, bad, drawn, n = 8, 14, 9, 20000
    got = np.bincount([S.hypergeometric(rng, good, bad, drawn) for _ in range(n)], minlength=9)
    want = np.array([math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(9)])
    assert np.abs(got / n - want).max() < 0.015
    big = [S.hypergeometric(rng, 4 * 10 ** 10, 6 * 10 ** 10, 10 ** 9) for _ in range(200)]
    assert abs(np.mean(big) / 4e8 - 1) < 1e-5 and 1e4 < np.std(big) < 2e4  # sd about 15 500
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3


def test_query_on_whole_table(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table("documents")}
    got = S.op4_hypergeometric_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = {}
    for r in got:
        t = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.op4_hypergeometric_shards(spark, SF).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_uniform_over_seeds(spark):
    df = spark.range(12).repartition(3)
    first = [0] * 3
    for seed in range(30):
        for r in S.shuffle_into_shards(df, ["id"], 3, seed=seed).collect():
            if r["id"] == 5:
                first[r["shard"]] += 1
    assert min(first) >= 3


def test_edge_cases(spark, make_docs):
    assert S.shuffle_into_shards(make_docs([]), ["doc_id"], 4).count() == 0
    few = S.shuffle_into_shards(make_docs([None, "a"], ids=[None, 3]), ["doc_id", "text"], 24).collect()
    assert sorted(r["slot"] for r in few) == [0, 0] and len({r["shard"] for r in few}) == 2
    same = spark.createDataFrame([(1, 9, 2)] * 50, "id int, shard int, __llm_x int")  # repeated rows, clashing column
    got = S.shuffle_into_shards(same, ["id"], 7).collect()
    sizes = sorted(sum(r["shard"] == s for r in got) for s in range(7))
    assert sizes == [7, 7, 7, 7, 7, 7, 8] and {r["id"] for r in got} == {1}


def test_rows_of_one_key_are_dealt_apart(spark):
    rows = [(i, k) for i in range(600) for k in range(2)]  # two copies of each key
    got = S.shuffle_into_shards(spark.createDataFrame(rows, "id int, k int").repartition(5), ["id"], 6).collect()
    assert sorted((r["id"], r["k"]) for r in got) == rows
    at = {}
    for r in got:
        at.setdefault(r["id"], []).append((r["shard"], r["slot"]))
    together = sum(a[0] == b[0] for a, b in at.values())
    next_to = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for a, b in at.values())
    assert 60 <= together <= 145 and next_to <= 10  # 100 and 1 expected; sd about 9


def test_a_hot_key_has_many_source_partitions(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 900, 1, 4).withColumn("key", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    nos = [r["__llm_no"] for r in S.numbered(df, ["key"], 8).where("key = -1").collect()]
    assert sorted(nos) == list(range(300))
    got = S.shuffle_into_shards(df, ["key"], 6).where("key = -1").collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(6)]
    assert sum(counts) == 300 and min(counts) >= 25

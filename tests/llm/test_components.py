import random

from bastion.llm import common as C


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(9, 9), (7000, 7000)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in C.connected_components(df).collect()}
    assert got == {x: top(x) for x in parent}


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_sample_is_exact_top_k(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.col("id") % 3).alias("c"), "id")
    got = {(r["c"], r["id"]) for r in C.hash_sample(df, "c", "id", F.when(F.col("c") == 0, 10).otherwise(25)).collect()}
    rows = [(r["c"], r["h"] % 2 ** 64, r["id"]) for r in df.withColumn("h", F.xxhash64("id")).collect()]
    want = {(c, i) for k in range(3) for c, _, i in sorted(x for x in rows if x[0] == k)[:10 if k == 0 else 25]}
    assert got == want

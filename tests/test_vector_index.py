"""V6: the persisted inverted index against exhaustive search (V5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bastion.operators.retrieval import retrieve
from bastion.operators.vector_index import build_index, candidates, encode, reachable, search_index
from bastion.operators.vectors import topk_join
from bastion.sources.driver_tables import table, vectors

ITEM, QUERY = "iid long, ns string, vec array<double>", "qid long, ns string, vec array<double>"


def clustered(seed, n, centres=12, dim=16, noise=0.25):
    rng = np.random.default_rng(seed)
    mid = np.random.default_rng(99).standard_normal((centres, dim))
    return [(mid[rng.integers(centres)] + noise * rng.standard_normal(dim)).tolist() for _ in range(n)]


def as_set(df):
    return {(r["qid"], r["iid"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("cells,near,block_rows", [(12, 2, 50_000), (30, 1, 7)])
def test_equals_exhaustive_search(spark, tmp_path, cells, near, block_rows):
    """Several keys, blocks within cells, tied copies, vectors without direction or of another length."""
    items = [(i, "abc"[i % 3], v) for i, v in enumerate(clustered(1, 700))]
    items += [(1000 + i, "a", items[0][2]) for i in range(9)] + [(2000, "a", None), (2001, "b", []), (2002, "a", [0.0] * 16), (2003, "a", [1.0] * 5), (2004, None, [1.0] * 16)]
    asked = [(i, k, v) for i, v in enumerate(clustered(2, 60)) for k in ("ab" if i % 2 else "c")]
    asked += [(900, "a", None), (901, "a", [1.0] * 5), (902, "b", [0.0] * 16), (903, "zzz", [1.0] * 16)]
    q, i = spark.createDataFrame(asked, QUERY), spark.createDataFrame(items, ITEM)
    index = build_index(i, str(tmp_path), 16, i_id="iid", i_key="ns", cells=cells, block_rows=block_rows)
    got = search_index(q, index, 4, q_id="qid", i_id="iid", q_key="ns", near=near)
    assert as_set(got) == as_set(topk_join(q, i, 4, q_id="qid", i_id="iid", key="ns"))


def test_clusters_are_pruned_and_probes_reach_the_recall(spark, tmp_path):
    i = spark.createDataFrame([(k, "a", v) for k, v in enumerate(clustered(3, 3000, 24, 32))], ITEM)
    q = spark.createDataFrame([(k, "a", v) for k, v in enumerate(clustered(4, 200, 24, 32))], QUERY)
    index = build_index(i, str(tmp_path), 32, i_id="iid", i_key="ns", cells=24)
    want = {(r["qid"], r["iid"]) for r in topk_join(q, i, 4, q_id="qid", i_id="iid", key="ns").collect()}
    fast = {(r["qid"], r["iid"]) for r in search_index(q, index, 4, q_id="qid", i_id="iid", q_key="ns", probes=2).collect()}
    assert len(fast & want) >= 0.95 * len(want)
    sizes = {r["cell"]: r["n"] for r in index.cells(spark).collect()}
    assert sum(sizes.values()) == 3000 and 2 * max(sizes.values()) <= 0.3 * 3000  # two cells are under three tenths
    rows = q.select(F.col("qid").alias("__q"), F.col("vec").alias("__qv"), F.col("ns").alias("key"))
    assert candidates(rows, index, 4).count() <= 0.02 * 200 * 3000


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_search_has_full_recall_and_reads_few_vectors(spark, tmp_path, sf):
    v = vectors(table(spark, f"/root/testdata/{sf}", "embeddings"))
    c = v.select(F.col("vec_id").alias("chunk_id"), "namespace", "vec")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "role", "vec")
    index = build_index(c, str(tmp_path), 64, i_id="chunk_id", i_key="namespace")
    pairs = lambda m, **kw: {(r["query_id"], r["chunk_id"], r["retrieval_rank"]) for r in retrieve(q, c, 4, method=m, exclude_self=True, **kw).collect()}
    want = pairs("block")
    assert pairs("index", index=index) == want
    sizes = {r["key"]: r["n"] for r in index.cells(spark).groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == v.count()
    rows = q.select(F.col("query_id").alias("__q"), F.col("vec").alias("__qv")).crossJoin(spark.createDataFrame([(k,) for k in sizes], "key string"))
    assert candidates(rows, index, 4, exclude_self=True).count() <= 0.3 * q.count() * v.count()


def test_search_reads_only_probed_partitions_and_codes(spark, tmp_path):
    i = spark.createDataFrame([(k, "ab"[k % 2], v) for k, v in enumerate(clustered(5, 400))], ITEM)
    index = build_index(i, str(tmp_path), 16, i_id="iid", i_key="ns", cells=4)
    scan = index.items(spark).where("key = 'a' and cell = 1").select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key" in scan and "ReadSchema: struct<id:bigint,code:binary>" in scan
    assert index.items(spark).where("key = 'a'").count() == 200


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, step, rest = encode(x)
    q = x[:40]
    middle = q @ (code * step[:, None]).T
    assert (np.abs(q @ x.T - middle) <= rest[None, :] + 1e-12).all() and rest.max() < 0.02
    centres = x[100:105]
    near = x @ centres.T
    cell = near.argmax(axis=1)
    spread = np.array([near[cell == c, c].min() for c in range(5)])
    best = reachable(q, centres, spread)
    assert all((q @ x[cell == c].T).max(axis=1)[k] <= best[k, c] + 1e-9 for c in range(5) for k in range(40))


def test_empty_index(spark, tmp_path):
    index = build_index(spark.createDataFrame([], ITEM), str(tmp_path), 16, i_id="iid", i_key="ns")
    q = spark.createDataFrame([(1, "a", [1.0] * 16)], QUERY)
    assert search_index(q, index, 4, q_id="qid", i_id="iid", q_key="ns").count() == 0


def random_search(seed, n, dim=16):
    return [(k, "a", v) for k, v in enumerate(np.random.default_rng(seed).standard_normal((n, dim)).tolist())]


def test_a_query_travels_once_to_a_shelf_however_many_cells_it_probes(spark, tmp_path):
    """Random vectors: no cell can be left out, so rows by query and cell would grow with the square of the table."""
    from bastion.operators import vector_index as V
    i = spark.createDataFrame(random_search(1, 600), ITEM)
    index = build_index(i, str(tmp_path), 16, i_id="iid", i_key="ns", cells=40)
    cells = index.cells(spark).toPandas()
    shelved = V._shelved(cells, index.centres, 300)
    assert 2 <= shelved["shelf"].nunique() <= 4 and shelved.groupby("shelf")["n"].sum().max() <= 300
    q = i.select(F.col("iid").alias("__q"), F.col("vec").alias("__qv"), F.col("ns").alias("key"), F.lit(-2.0).alias("floor"))
    plan = "__q long, __qv array<double>, floor double, key string, shelf int, blocks int, bits binary"
    rounds = [q.mapInArrow(V._probes(index, shelved, 4, later), plan).collect() for later in (False, True)]
    assert all(len(r) <= 600 * shelved["shelf"].nunique() for r in rounds)
    # every cell is probed once: in the first round or in the later one
    probed = [sum(bin(b).count("1") for r in rows for b in r.bits) for rows in rounds]
    assert probed[0] == 4 * 600 and sum(probed) == 600 * len(cells)


@pytest.mark.parametrize("shelf_rows", [60, 50_000])
def test_shelves_and_copies_of_one_vector_equal_exhaustive_search(spark, tmp_path, shelf_rows):
    """Copies of one vector are candidates k + 1 times a block at most, with the same answer."""
    items = random_search(2, 400)
    items += [(1000 + k, "a", items[3][2]) for k in range(300)]
    i = spark.createDataFrame(items, ITEM)
    q = i.select(F.col("iid").alias("qid"), "ns", "vec")
    index = build_index(i, str(tmp_path), 16, i_id="iid", i_key="ns", cells=20)
    got = search_index(q, index, 4, q_id="qid", i_id="iid", q_key="ns", exclude_self=True, shelf_rows=shelf_rows)
    want = topk_join(q, i, 4, q_id="qid", i_id="iid", key="ns", exclude_self=True)
    assert as_set(got) == as_set(want)
    rows = q.select(F.col("qid").alias("__q"), F.col("vec").alias("__qv"), F.col("ns").alias("key"))
    assert candidates(rows, index, 4, exclude_self=True).count() <= 12 * 700

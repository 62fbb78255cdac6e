import random

import numpy as np
import pytest
import xxhash

from bastion.llm import simhash as S

from .helpers import SF, table, words


def fingerprint(text):
    w = words(text)
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Smallest id reachable by comparing all pairs."""
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(top(k), []).append(i)
    return [min((i for i in groups[top(k)] if i is not None), default=None) for k in range(len(prints))]


def test_driver_table(spark):
    docs = table("documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op11_pivot_simhash(spark, SF).collect()}
    prints, ids = [fingerprint(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids))}


def test_edge_cases(make_docs):
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE  TWO", "a b c", "É x y z", "a b c a b c a b c", "a b c"]
    got = sorted((r["id"], r["point"] % 2 ** 64, r["component_id"]) for r in S.near_components(make_docs(texts)).collect())
    prints = [fingerprint(t) for t in texts]
    assert got == [(i, p, c) for i, (p, c) in enumerate(zip(prints, components(prints, list(range(len(texts))))))]
    assert prints[0] == 0 and got[2][2] == 0


def test_null_and_repeated_ids_empty_table_clashing_columns(make_docs):
    from pyspark.sql import functions as F
    a, b = "a b c d e f g", "h i j k l m n"
    df = make_docs([a, a, b, b, b], ids=[None, 4, None, None, None]).withColumn("point", F.lit("x")).withColumn("cell", F.lit(1))
    got = sorted((r["component_id"] is None, r["component_id"] or 0) for r in S.near_components(df).collect())
    assert got == [(False, 4), (False, 4), (True, 0), (True, 0), (True, 0)]
    assert S.near_components(make_docs([])).count() == 0


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "Bb", "c" * 700, "d", "\n e"]) for _ in range(3000))
    whole = fingerprint(text)
    monkeypatch.setattr(S.C, "SLICE_BYTES", 512)
    assert S.fingerprints_of([text.encode(), b"", text.encode()]).tolist() == [whole, 0, whole]


def families(seed, count, each, most_flips):
    """Random points with members a few bits away, walks of one and two bits among them."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        x = int(rng.integers(0, 2 ** 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(each):
            y = x
            for k in rng.choice(64, rng.integers(0, most_flips + 1), replace=False):
                y ^= 1 << int(k)
            out.append(y)
            if rng.random() < 0.3:
                x = y
    return sorted(set(out))


@pytest.mark.parametrize("most", [1 << 16, 16])
def test_links_against_all_pairs(spark, most):
    """Random families and one dense ball, whose cells the pivots cannot part."""
    points = sorted(set(families(1, 150, 6, 4) + families(2, 1, 500, 3) + families(3, 700, 1, 0)))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "point long")
    label = {r["node"] % 2 ** 64: r["component"] % 2 ** 64 for r in S.C.connected_components(S.links(df, most)).collect()}
    want = components(points, list(range(len(points))))
    mine, other = {}, {}
    for k, p in enumerate(points):
        mine.setdefault(label.get(p, p), set()).add(p)
        other.setdefault(want[k], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))
    assert len(mine) < len(points) - 300


@pytest.mark.parametrize("small", [512, 2])
def test_a_task_of_whole_cells(monkeypatch, small):
    """The kernel alone, with cuts in memory: all links within a cell, none between cells."""
    import pandas as pd
    monkeypatch.setattr(S, "SMALL", small)
    points = np.array(families(8, 200, 5, 3) + families(9, 1, 200, 2), dtype=np.uint64)
    cell = np.random.default_rng(1).integers(0, 3, len(points))
    got = S._close(pd.DataFrame({"cell": cell, "point": points.view(np.int64)}))
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    mine = S.roots(len(points), *(np.array([at[int(x)] for x in got[c]], int) for c in ("a", "b")))
    near = (np.bitwise_count(points[:, None] ^ points[None, :]) <= 2) & (cell[:, None] == cell[None, :])
    assert (mine == S.roots(len(points), *np.nonzero(near))).all()


def test_cells_are_bounded_and_keep_linked_points_together(spark):
    points = sorted(set(families(5, 1, 3000, 5) + families(6, 300, 4, 2)))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "point long")
    rows, _ = S.cells(df, 128)
    cells = {}
    for r in rows.collect():
        cells.setdefault(r["cell"], set()).add(r["point"] % 2 ** 64)
    assert max(map(len, cells.values())) <= 2 * 128 * 1.5  # blocks are dealt by a hash
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b and (a ^ b).bit_count() <= 2}
    assert met == {(a, b) for k, a in enumerate(points) for b in points[k + 1:] if (a ^ b).bit_count() <= 2}

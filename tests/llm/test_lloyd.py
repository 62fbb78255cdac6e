import hashlib
import math
import random

import numpy as np
import pytest

from bastion.llm import lloyd as L

from .helpers import SF, table

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python: {row index: (code, error)}, codebooks. Rows: (id, vector) of one length."""
    ints = [[math.floor(4096 * x) for x in v] for _, v in rows]
    width = len(ints[0]) // parts
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0], ints[k]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(ints[k], p) for k in order] for p in range(parts)]
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(cut(v, p), books[p][e])), e))
                  for p in range(parts)] for v in ints]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, c in zip(ints, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(cut(v, p), books[p][c[p]])) for p in range(parts)) for v, c in zip(ints, codes)]
    return [("".join(f"{e:02x}" for e in c), err) for c, err in zip(codes, errors)], books


def test_driver_table(spark):
    rows = table("embeddings")
    want, books = plain([(r["vec_id"], r["embedding"]) for r in rows])
    by_label = {}
    for r, (_, e) in zip(rows, want):
        by_label[r["label"]] = by_label.get(r["label"], 0) + e
    name = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in L.op13_active_lloyd_codes(spark, SF).collect()}
    assert got == {r["vec_id"]: (c, e, by_label[r["label"]], name) for r, (c, e) in zip(rows, want)}


@pytest.mark.parametrize("seed", range(6))
def test_active_entries_give_the_full_rescan(seed):
    """Coarse integers make many ties; the shortcut must equal a comparison with all entries, with fewer comparisons."""
    rng = np.random.default_rng(seed)
    x, old = rng.integers(-4, 5, (400, 3)), rng.integers(-4, 5, (16, 3))
    code, gap = L.nearest(x, old)
    moved = rng.random(16) < 0.3
    new = old.copy()
    new[moved] += rng.integers(-2, 3, (int(moved.sum()), 3))
    got_code, got_gap, made = L.reassign(x, new, (new != old).any(axis=1), code, gap)
    want_code, want_gap = L.nearest(x, new)
    assert (got_code == want_code).all() and (got_gap == want_gap).all() and made < 400 * 16


def test_ties_repeated_and_null_ids(spark):
    rng = random.Random(1)
    vectors = [[rng.choice([-0.5, 0.0, 0.25]) for _ in range(8)] for _ in range(120)]
    ids = [None, 3, 3, *range(4, 119), 118, 5]
    df = spark.createDataFrame([(i, v, k % 3 or None) for k, (i, v) in enumerate(zip(ids, vectors))], SCHEMA)
    got, books = L.compress(df, keep=("label",))
    want, want_books = plain(list(zip(ids, vectors)))
    assert books.tolist() == want_books
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"] or 0) for r in got.collect()), key=key) == sorted(
        ((i, c, e, k % 3) for k, (i, (c, e)) in enumerate(zip(ids, want))), key=key)


def test_left_out_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, None, *[0.0] * 6], 1), (3, [nan] + [0.0] * 7, 1), (4, [-inf] + [0.0] * 7, 1), (9, [0.1] * 7, 2), (10, [], 2),
            (11, [1e30] + [0.0] * 7, None), (12, [0.1] * 8, None), (13, [0.2] * 8, 5), (14, [0.1] * 16, 5)]
    got, books = L.compress(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "code"), keep=("code",))
    got = {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()}
    assert books.shape == (8, 2, 1)
    assert got == {9: (None, None), 10: (None, None), 11: (None, None), 14: (None, None), 12: ("00" * 8, 0), 13: ("01" * 8, 0)}
    empty, none = L.compress(spark.createDataFrame([], SCHEMA), keep=("label",))
    assert none is None and empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error"]


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert L.op13_active_lloyd_codes(spark, str(tmp_path)).count() == 0


def test_floors_go_down():
    books = np.array([[[0]], [[5]]])

    class Sums:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def collect(self):
            return [{"pos": 0, "s": -7}, {"pos": 1, "s": 2}, {"pos": 2, "s": 0}, {"pos": 3, "s": 0}]

    assert L.updated(Sums(), books).tolist() == [[[-4]], [[5]]]

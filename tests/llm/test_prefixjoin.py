import random

import pytest

from bastion.llm import prefixjoin as P

from .helpers import SF, components, shingles, table


def check(df, texts, ids):
    got = sorted((r["id"], r["mark"], r["n_shingles"], r["component_id"]) for r in P.near_components(df).collect()) if None not in ids else None
    want = components(texts, ids)
    if got is None:
        return
    by_id = {i: (len(shingles(t)), c) for i, t, c in zip(ids, texts, want)}
    assert len(got) == len(ids)
    assert {i: (n, c) for i, _, n, c in got} == by_id


def near_texts(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 9)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_against_all_pairs(make_docs, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_texts(1, 60, 30, 4) + near_texts(2, 40, 12, 3) + near_texts(3, 9, 8, 1)
    texts += [f"{passage} own{i} " + " ".join(f"q{i}x{k}" for k in range(15 + 3 * i)) for i in range(8)]
    texts += ["one two", "one two", "three", None, "", "  ", texts[0], texts[0].upper()]
    random.Random(4).shuffle(texts)
    check(make_docs(texts), texts, list(range(len(texts))))


def test_driver_table(spark):
    docs = table("documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in P.op3_grouped_prefix_join(spark, SF).collect()}
    texts, ids = [r["text"] for r in docs], [r["doc_id"] for r in docs]
    assert got == {i: (len(shingles(t)), c) for i, t, c in zip(ids, texts, components(texts, ids))}


def test_threshold_is_exact(make_docs):
    # 100 * i >= 75 * u: sets of 7 and 6 shingles sharing 6 give 6/7; of 8 and 6 give 6/8 = 0.75; of 9 and 6 give 6/9
    base = [f"b{i}" for i in range(10)]
    texts = [" ".join(base), " ".join(base + ["x1", "x2"]), " ".join(base + ["y1", "y2", "y3"])]
    got = {r["id"]: r["component_id"] for r in P.near_components(make_docs(texts)).collect()}
    assert got == dict(zip(range(3), components(texts, [0, 1, 2]))) and got[1] == 0


def test_null_and_repeated_ids_and_empty_table(make_docs):
    a, b = "a b c d e f g", "h i j k l m n"
    got = P.near_components(make_docs([a, a, b, b, None], ids=[None, 4, None, None, None])).collect()
    assert sorted((r["component_id"] is None, r["component_id"] or 0) for r in got) == [(False, 4), (False, 4), (True, 0), (True, 0), (True, 0)]
    assert P.near_components(make_docs([])).count() == 0
    two = P.near_components(make_docs([a, b], ids=[7, 7])).collect()  # one id, two texts: judged by text
    assert [r["component_id"] for r in two] == [7, 7] and all(r["first"] for r in two)


def test_keep_first(make_docs):
    from pyspark.sql import functions as F
    a = "a b c d e f g h"
    df = make_docs([a, a + "", "z y x w v", None, "", a.upper()], ids=[3, 1, 2, 9, 10, 1]).withColumn("__llm_n", F.lit(1))
    got = P.keep_first(df)
    assert got.columns == df.columns
    kept = sorted((r["doc_id"], r["text"]) for r in got.collect() if r["text"])
    assert len(kept) == 2 and kept[0][0] == 1 and kept[1] == (2, "z y x w v")
    assert got.count() == 4  # rows without words stay
    again = make_docs([a, a, a], ids=[5, 5, 5])
    assert P.keep_first(again).count() == 1


@pytest.mark.parametrize("block", [1024, 4])
def test_number_of_links_against_all_pairs(make_docs, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    texts = near_texts(1, 60, 30, 4) + near_texts(2, 40, 12, 3) + ["one two", "one two", "three", None, ""]
    texts += [texts[0], texts[0].upper(), texts[31]]  # equal sets are links as well
    random.Random(4).shuffle(texts)
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(bool(linked(a, b)) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)}
    got = P.near_components(make_docs(texts), count_links=True).collect()
    assert {r["id"]: r["n_links"] for r in got} == want and max(want.values()) > 5
    named = components(texts, list(range(len(texts))))
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["id"])] == named


def test_query_gives_number_of_links(spark):
    docs = table("documents")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs}
    want = {i: sum(1 for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)) for i, a in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in P.op3_grouped_prefix_join(spark, SF).collect()} == want


def chain(windows, words=200, step=100):
    """Windows that share half of their words with the next: one cluster by shared shingles, no link anywhere."""
    stream = [f"s{k}" for k in range(step * windows + words)]
    return [" ".join(stream[step * k:step * k + words]) for k in range(windows)]


def test_a_chain_of_overlapping_windows_makes_few_pairs(make_docs, monkeypatch):
    pairs = []
    kept = P.pair_links
    monkeypatch.setattr(P, "pair_links", lambda sets, found, classes: pairs.append(found.count()) or kept(sets, found, classes))
    texts = chain(2000) + near_texts(5, 120, 40, 2)
    got = P.near_components(make_docs(texts), count_links=True).collect()
    assert pairs and pairs[0] < 10_000
    assert all(r["n_links"] == 0 and r["component_id"] == r["id"] for r in got if r["id"] < 2000)
    assert len({r["component_id"] for r in got if r["id"] >= 2000}) < 40


def test_clusters_taken_apart_lose_no_link(make_docs, monkeypatch, sparse=3):
    """Chains, near copies of their windows and dense families in one cluster, in tiny blocks."""
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "SPARSE", sparse)
    rng = random.Random(9)
    texts = chain(30, 80, 30)
    for k in range(0, 30, 3):
        for _ in range(rng.randrange(1, 7)):
            w = texts[k].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 9)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[33], texts[33].upper(), "", None] + near_texts(6, 60, 25, 3)
    random.Random(4).shuffle(texts)
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    want = [sum(bool(linked(a, b)) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    got = sorted(P.near_components(make_docs(texts), count_links=True).collect(), key=lambda r: r["id"])
    assert [r["n_links"] for r in got] == want
    named = components(texts, list(range(len(texts))))
    assert [r["component_id"] for r in got] == named
    plain = sorted(P.near_components(make_docs(texts)).collect(), key=lambda r: r["id"])
    assert [r["component_id"] for r in plain] == named


def test_intersections_counted_pair_by_pair_equal_products():
    import numpy as np
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 4000, 60)).astype(np.uint64) for _ in range(50)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(want, 0)
    got = P.common(sets)
    np.fill_diagonal(got, 0)
    assert (got == want).all() and (P.common(sets[:20], sets[20:]) == want[:20, 20:]).all()


def test_a_very_long_text_and_clashing_columns(make_docs):
    from pyspark.sql import functions as F
    long = " ".join(f"w{k % 9973}x{k // 9973}" for k in range(300_000))
    df = make_docs([long, long + " tail", "a b c d e f", None]).withColumn("node", F.lit("x")).withColumn("mark", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in P.near_components(df).collect()}
    assert got == {0: (299_996, 0), 1: (299_997, 0), 2: (2, 2), 3: (0, 3)}

import hashlib

import numpy as np

from bastion.llm import common as C
from bastion.llm import minhash as M

from .helpers import SF, shingles, table


def rows(df):
    return {r["id"]: r for r in df.collect()}


def test_against_brute_force_on_whole_table(spark):
    docs = sorted(table("documents"), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in M.op1_minhash_fingerprints(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    errors = []
    for k, row in enumerate(docs):
        text, after = row["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = got[row["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_equal_texts_equal_fingerprints_and_edge_cases(make_docs):
    df = make_docs(["one two three four five six", "ONE two  three four\nfive six", None, "", " \t", "word"])
    got = [r["fingerprint"] for r in M.fingerprints(df).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2] == got[3] == got[4] == "" and got[5] not in ("", got[0])
    assert len(got[0]) == M.BINS * M.BITS // 4


def test_next_row_wraps_and_orders_ties(make_docs):
    got = rows(M.edited_fingerprints(make_docs(["aaaa", None, "bb cc"], ids=[5, 7, 9])))
    assert got[5]["edited_text"] == "aa" and got[9]["edited_text"] == "bb aa"[:3] + "aa"
    one = rows(M.edited_fingerprints(make_docs(["ab cd"], ids=[None])))
    assert one[None]["edited_text"] == "ab ab"
    assert M.edited_fingerprints(make_docs([])).count() == 0
    tied = M.edited_fingerprints(make_docs(["bb", "aa", "cc"], ids=[1, 1, 2])).collect()
    assert sorted(r["edited_text"] for r in tied) == ["ab", "bc", "ca"]


def test_many_ranges_keep_every_successor(spark, make_docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        texts = [f"t{i}" * (i % 7 + 1) for i in range(200)]
        got = rows(M.edited_fingerprints(make_docs(texts).repartition(9)))
        for i, t in enumerate(texts):
            assert got[i]["edited_text"] == t[:len(t) - len(t) // 2] + texts[(i + 1) % 200][:len(t) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bias_correction_and_densification_are_unbiased():
    rng = np.random.default_rng(3)
    for size, overlap in ((20, 0.5), (100, 0.8), (2000, 0.3)):
        errors = []
        for _ in range(60):
            both = int(size * overlap)
            shared, a, b = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n)) for n in (both, size - both, size - both)]
            left, right = f"{shared} {a}", f"{shared} {b}"
            data = np.frombuffer((left + right).encode(), np.uint8)
            marks = M.sketch(data, np.array([0, len(left), len(left) + len(right)]))
            x, y = shingles(left), shingles(right)
            errors.append(M.similarity(marks[:1], marks[1:])[0] - len(x & y) / len(x | y))
        assert abs(np.mean(errors)) < 0.03, (size, overlap)


def test_pack_round_trip_and_likeness(spark):
    row = np.arange(M.BINS, dtype=np.uint8) % 16
    assert (M.unpack(M.pack(row)) == row).all()
    df = spark.createDataFrame([(M.pack(row), M.pack(row)), ("", ""), ("", M.pack(row)), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(M.likeness("a", "b")).collect()] == [1.0, 1.0, 0.0, None]


def test_words_do_not_depend_on_slices(monkeypatch):
    text = ("abc " * 50 + "x" * 300 + " déjà\tvu\n").encode() * 3
    data, offs = np.frombuffer(text, np.uint8), np.array([0, 100, 100, 731, len(text)])
    whole = C.shingle_hashes(data, offs)
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    cut = C.shingle_hashes(data, offs)
    for a, b in zip(whole, cut):
        assert (a == b).all()


def test_clashing_columns(make_docs):
    from pyspark.sql import functions as F
    df = make_docs(["a b c d e f"]).withColumn("fingerprint", F.lit(1)).withColumn("id", F.lit("x")).withColumn("__llm_part", F.lit(2))
    assert M.fingerprints(df).select("fingerprint").first()[0] != "1"
    assert M.edited_fingerprints(df).count() == 1

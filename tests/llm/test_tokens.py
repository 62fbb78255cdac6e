import numpy as np
from pyspark.sql import functions as F

from bastion.llm import tokens as T

from .helpers import SF, table


def test_query_against_the_tokeniser(spark):
    coder = T.encoder(T.VOCABULARY)
    want = {r["doc_id"]: len(coder.encode_ordinary(r["text"] or "")) for r in table("documents")}
    got = T.op9_separator_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)


def test_small_blocks_and_edge_cases(make_docs):
    texts = ["a long text " * 40, None, "", "x", "<|endoftext|> is text", "x", "y " * 500]
    df = make_docs(texts, ids=[0, 1, 2, 3, 4, 3, None]).withColumn("file", F.lit("clash")).withColumn("block", F.lit(1))
    coder = T.encoder(T.VOCABULARY)
    want = sorted((len(coder.encode_ordinary(t or "")), i is None, i or 0) for t, i in zip(texts, [0, 1, 2, 3, 4, 3, None]))
    for size in (1, 7, 64, 1 << 18):
        blocks = T.flat_tokens(df.coalesce(1), block_tokens=size)
        assert blocks.select(F.max(F.octet_length("payload"))).first()[0] <= 2 * size
        got = T.separator_scan(blocks).join(T.manifest(blocks), ["file", "ordinal"]).collect()
        assert sorted((r["n_tokens"], r["id"] is None, r["id"] or 0) for r in got) == want and all(r["closed"] for r in got)
    assert T.separator_scan(T.flat_tokens(make_docs([]))).count() == 0


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 6, 1000).astype("<u4")
    flat[-1] = 1
    ends = np.flatnonzero(flat == 5)
    starts = np.concatenate([[0], ends + 1])
    want = [(k, int(a), int(b - a), k < len(ends)) for k, (a, b) in enumerate(zip(starts, np.append(ends, 1000)))]
    for size in (3, 10, 999, 5000):
        rows = [("f", k, flat[a:a + size].tobytes()) for k, a in enumerate(range(0, 1000, size))] + [("null", 0, None), ("empty", 0, b"")]
        df = spark.createDataFrame(rows, "file string, block long, payload binary").repartition(5)
        got = sorted((r["ordinal"], r["begin"], r["n_tokens"], r["closed"]) for r in T.separator_scan(df, end_id=5, width=4).collect())
        assert got == want


def test_raw_files(spark, tmp_path):
    flat = np.array([1, 2, 9, 3, 9, 9, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = T.file_blocks(spark, str(tmp_path), block_tokens=2)
    got = sorted((r["ordinal"], r["n_tokens"], r["closed"]) for r in T.separator_scan(blocks, end_id=9).collect())
    assert got == [(0, 2, True), (1, 1, True), (2, 0, True), (3, 1, False)]


def test_two_level_scan_over_many_groups(spark, monkeypatch):
    """Blocks without separators, whole groups without any, a file that ends open."""
    monkeypatch.setattr(T, "GROUP", 3)
    rng = np.random.default_rng(4)
    flat = np.where(rng.random(600) < 0.02, 7, 1).astype("<u2")
    flat[200:300] = 1
    ends = np.flatnonzero(flat == 7)
    starts = np.concatenate([[0], ends + 1])
    want = [(k, int(a), int(b - a), k < len(ends)) for k, (a, b) in enumerate(zip(starts, np.append(ends, 600))) if a < 600]
    rows = [("f", k, flat[a:a + 8].tobytes()) for k, a in enumerate(range(0, 600, 8))]
    df = spark.createDataFrame(rows, "file string, block long, payload binary").repartition(4)
    got = sorted((r["ordinal"], r["begin"], r["n_tokens"], r["closed"]) for r in T.separator_scan(df, end_id=7).collect())
    assert got == want


def test_a_raw_file_of_many_blocks_is_cut_into_slices(spark, tmp_path):
    flat = np.full(3_000_000, 3, "<u2")
    flat[[10, 2_999_999]] = 9
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    blocks = T.file_blocks(spark, str(tmp_path), block_tokens=1 << 16)
    assert blocks.select(F.max(F.octet_length("payload")), F.count("*"), F.sum(F.octet_length("payload"))).first()[:] == (2 << 16, 46, 6_000_000)
    assert sorted(r["n_tokens"] for r in T.separator_scan(blocks, end_id=9).collect()) == [10, 2_999_988]

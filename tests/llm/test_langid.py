import zlib

import numpy as np
from pyspark.sql import functions as F

from bastion.llm import langid as K

from .helpers import table

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_whole_table(spark):
    lang = {r["doc_id"]: r["lang"] for r in table("documents", MID)}
    got = K.op6_kernel_language_id(spark, MID).collect()
    assert {r["doc_id"] for r in got} == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_presence_against_brute_force():
    text = "Äb c! Abc 12\nxyzzy".encode()
    data, offs = np.frombuffer(text + b"abcd", np.uint8), np.array([0, len(text), len(text) + 4])
    got = K.presence(data, offs)
    for row, raw in enumerate((text, b"abcd")):
        clean = bytes(int(K._LETTER[b]) for b in raw)
        want, base = set(), 0
        for k, slots in enumerate(K.SLOTS, start=1):
            for i in range(len(clean) - k + 1):
                code = int.from_bytes(clean[i:i + k], "big")
                want.add(base + (code if k == 1 else (code * 2654435761 % 2 ** 32) >> (32 - slots.bit_length() + 1)))
            base += slots
        assert set(np.flatnonzero(got[row]).tolist()) == want


def test_presence_does_not_depend_on_slices(monkeypatch):
    data = np.frombuffer("Der schnelle braune Fuchs é ".encode() * 40, np.uint8)
    offs = np.array([0, 17, 17, 500, len(data)])
    whole = K.presence(data, offs)
    monkeypatch.setattr(K.C, "SLICE_BYTES", 33)
    assert (K.presence(data, offs) == whole).all()


def test_nystrom_with_all_landmarks_is_kernel_ridge():
    rng = np.random.default_rng(0)
    bits = rng.random((30, K.WIDTH)) < 0.02
    labels = ["a"] * 15 + ["b"] * 15
    model = K.fit_rows(bits, labels, landmarks=30, ridge=1e-2)
    k = model.kernel(bits)[:, :]
    order = [int(np.flatnonzero((model.landmarks == b).all(axis=1))[0]) for b in bits]
    k = k[:, order].astype(float)
    # min (1/n) |K a - y|^2 + (ridge / n) a' K a has a = (K + ridge I)^-1 y
    target = np.where(np.arange(30)[:, None] < 15, [[1.0, -1.0]], [[-1.0, 1.0]])
    want = k @ np.linalg.solve(k + 1e-2 * np.eye(30), target)
    assert np.allclose(model.kernel(bits) @ model.weights, want, atol=1e-3)


def test_edge_cases(spark, make_docs):
    texts = ["the cat and the dog", "der hund und die katze", "the house", "das haus und", None, "", "123 !?", "Ж", "the " * 50000]
    df = make_docs(texts, langs=["en", "de", "en", "de", None, "en", "en", None, "en"], ids=[0, 1, 3, 4, 5, None, 7, 8, 9])
    df = df.withColumn("lang_pred", F.lit(1)).withColumn("id", F.lit(2)).withColumn("label", F.lit(3))
    model = K.fit(df)
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in K.classify(df, model).collect()}
    assert all(got[t] == ("und", 0.0) for t in (None, "", "123 !?")) and got["Ж"][0] != "und"
    none = K.classify(df, K.fit(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    empty = df.limit(0)
    assert K.classify(empty, K.fit(empty)).count() == 0

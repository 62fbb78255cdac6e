import zlib

import numpy as np
from pyspark.sql import functions as F

from bastion.llm import toxicity as X

from .helpers import table

MID = "/root/testdata/sf0.1"


def test_grammar_classes():
    model = X.Model(insults=["blorg"], slurs=["zap"])
    name = lambda text: [k for k, n in enumerate(model.read(text)[1]) if n]
    assert name("such a blorgish thing") == [0]
    assert name("not a blorg") == [1] and name("not that any of us is a blorg") == [0]
    assert name("someone said the blorg left") == [2] and name("he said the blorg left") == [2 + 4]
    assert name("you blorg") == [4] and name("not you, blorg") == [0]
    assert name("someone wrote no blorg") == [3]
    assert name("you zap") == [8 + 4] and name("never kill") == [16 + 1]
    assert name("a blorg. not a blorg! you") == [0, 1]
    assert name("nothing here") == []


def test_composition_is_the_product():
    a, b = X.since(X.NEGATION), X.within(X.REPORT)
    both = X.compose(a, b)
    rng = np.random.default_rng(1)
    state, sa, sb = 0, 0, 0
    for symbol in rng.integers(0, X.SYMBOLS, 400):
        if symbol in X.KINDS:
            assert both.out[state][symbol] == 4 * X.KINDS.index(symbol) + a.says[sa] + 2 * b.says[sb]
        else:
            assert both.out[state][symbol] == -1
        state, sa, sb = both.step[state][symbol], a.step[sa][symbol], b.step[sb][symbol]


def test_stems():
    counts = {"trol": (40, 0), "troll$": (3, 0), "troll": (40, 0), "trolls": (37, 0), "trolls$": (37, 0), "the$": (90, 900), "rare$": (3, 0), "mixe": (60, 40), "mixed$": (60, 40)}
    assert X.choose_stems(counts, 3000, 30000) == (["troll"], ["mixed$"])
    assert X.choose_stems(counts, 0, 10) == ([], [])


def test_held_out_quality_on_whole_table(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels", MID)}
    got = X.op8_grammar_toxicity(spark, MID).collect()
    assert len(got) == len(table("documents", MID))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    caught = np.mean([p for t, p in held if t == 1])
    wrong = np.mean([p for t, p in held if t == 0])
    assert caught > 0.9 and wrong < 0.01, (caught, wrong)


def test_edge_cases(spark, make_docs):
    df = make_docs([None, "", "you idiot", "fine day", "you idiot"], ids=[0, None, 2, 3, 4]).withColumn("score", F.lit("x")).withColumn("toxic", F.lit("y"))
    for rows in ([], [(0, None), (None, 1)], [(2, 1), (2, 0), (3, 0), (3, None)]):
        labels = spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")
        got = X.score(df, X.fit(df, labels)).collect()
        by = [(r["text"], r["score"], r["predicted"]) for r in got]
        assert len(by) == 5 and len({s for t, s, _ in by if not t}) == 1
        same = [x for x in by if x[0] == "you idiot"]
        assert same[0] == same[1] and same[0][2] == 1 and all(p == 0 for t, _, p in by if t != "you idiot")
    empty = df.limit(0)
    assert X.score(empty, X.Model()).count() == 0


def test_a_clause_counts_once_with_its_weightiest_match():
    model = X.Model(insults=["blorg"], slurs=["zap"])
    name = lambda text: {k: n for k, n in enumerate(model.read(text)[1]) if n}
    assert name("you blorg blorg zap. zap zap") == {4: 1, 8: 1}
    assert name("not a blorg you blorg") == {4: 1}
    assert name("blorg, blorg, blorg") == {0: 3}


def labelled_corpus(seed=3):
    """Texts of made-up words; the toxic ones hold a three-letter word that clean ones never have."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abdeilmnorstu"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, 400, 30)]
        if toxic := i % 4 == 0:
            text.insert(int(rng.integers(0, 30)), "zkq")
        rows.append((i, " ".join(text) + ("." if i % 2 else " q x"), int(toxic)))
    return rows


def test_a_three_letter_insult_is_learned(spark):
    rows = labelled_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels)
    assert "zkq$" in model.insults
    got = {r["doc_id"]: r["predicted"] for r in X.score(docs, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97


def test_stem_counts_against_brute_force(spark):
    import re
    rows = labelled_corpus(5)[:120] + [(900, "a bb ccc dddd eeeee dddd", 1), (901, "a bb ccc dddd eeeee dddd", 1), (902, "", 0), (903, "É ééééé x", 0)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int")
    got = {r["stem"]: (r["t"], r["c"]) for r in X.stem_counts(df).collect()}
    assert "bb$" in got and "a$" in got and "ccc$" in got and "ccc" not in got
    # neighbours are compared by Spark's hash there: take its smallest per text and word from Spark as well
    pairs = []
    for i, text, toxic in rows:
        w = re.findall(r"[^\W\d_]+", text.lower())
        pairs += [(i, toxic, x, w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None) for k, x in enumerate(w)]
    near = spark.createDataFrame(pairs, "id long, toxic int, word string, a string, b string").withColumn("near", F.xxhash64("a", "b")).collect()
    least = {}
    for r in near:
        least[r["id"], r["toxic"], r["word"]] = min(least.get((r["id"], r["toxic"], r["word"]), r["near"]), r["near"])
    want = {}
    for toxic, word, _ in {(t, w, n) for (_, t, w), n in least.items()}:
        for stem in {word + "$"} | {word[:k] for k in range(4, len(word) + 1)}:
            t, c = want.get(stem, (0, 0))
            want[stem] = (t + toxic, c + 1 - toxic)
    assert got == want


def test_a_very_long_text_counts_its_clauses():
    model = X.Model(insults=["blorg"])
    n, counts = model.read("you blorg, fine words here. " * 100_000)
    assert n == 500_000 and counts[4] == 100_000 and sum(counts) == 100_000

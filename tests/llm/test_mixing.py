import numpy as np
import pytest
from pyspark.sql import functions as F

from bastion.llm import common as C
from bastion.llm import mixing as M

from .helpers import SF

MID = "/root/testdata/sf0.01"


def slow_rates(p, tokens, wanted, start, rounds=200):
    """Projected gradient in the Gram metric, one array of rates."""
    gram = (p * tokens[:, None]).T @ p
    inverse, r = np.linalg.pinv(gram, rcond=1e-10), np.full(len(p), start)
    for _ in range(rounds):
        gap = (r * tokens) @ p - wanted
        if np.abs(gap).max() <= 1e-5 * wanted.sum():
            break
        r = np.maximum(0, r - p @ (inverse @ gap))
    return r


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.1, "c": 0.0}])
def test_rates_against_brute_force(spark, targets):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = rng.integers(0, 500, 200)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>")
    fit = M.fit_rates(rows, ["a", "b", "c"], targets, rounds=200)
    got = np.array([r[0] for r in rows.select(fit.rate(F.col("posterior"))).collect()])
    wanted = tokens.sum() * np.array([targets[k] for k in "abc"])
    assert got.min() >= 0
    assert np.allclose(np.sort(got), np.sort(slow_rates(p, tokens.astype(float), wanted, 1.0)), atol=1e-2)
    assert np.allclose(fit.totals, (got * tokens) @ p)
    if targets["c"]:
        assert np.abs((got * tokens) @ p - wanted).max() <= 1e-5 * wanted.sum()


def test_whole_table(spark):
    docs = C.read(spark, MID, "documents")
    out, model, fit = M.mix(docs.select("doc_id", "text"), M.label_domains(C.read(spark, MID, "labels"), docs))
    rows = out.collect()
    assert len(rows) == docs.count() and set(model.domains) == {"de", "en", "es", "fr", "poor"}
    p, t, r = np.array([x["posterior"] for x in rows]), np.array([x["tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and r.min() >= 0
    total = (r * t) @ p
    assert np.allclose(total / total.sum(), [M.TARGETS[d] for d in model.domains], atol=1e-3)
    copies = np.array([x["copies"] for x in rows])
    assert (np.abs(copies - r) < 1).all() and abs((copies * t).sum() / (r * t).sum() - 1) < 0.1
    lang = {x["doc_id"]: x["lang"] for x in docs.collect()}
    bad = {x["doc_id"] for x in C.read(spark, MID, "labels").where("quality = 0").collect()}
    sure = [model.domains[int(np.argmax(x["posterior"]))] == ("poor" if x["doc_id"] in bad else lang[x["doc_id"]]) for x in rows]
    assert np.mean(sure) > 0.9


def test_edge_cases(spark, make_docs):
    df = make_docs([None, "", "a b c", "a b c", "d"], ids=[0, None, 1, 2, 2]).withColumn("tokens", F.lit("x")).withColumn("domain", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, domain string")
    out, model, _ = M.mix(df, none)
    assert model.domains == ["all"] and {(r["rate"], r["copies"]) for r in out.collect()} == {(1.0, 1)}
    some = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "x"), (2, "y")], "doc_id long, domain string")
    out, model, _ = M.mix(df, some, targets={"x": 1.0, "y": 1.0, "other": 3.0})
    rows = out.collect()
    assert len(rows) == 5 and [r["tokens"] for r in rows if not r["text"]] == [0, 0]
    same = [(r["rate"], r["posterior"]) for r in rows if r["text"] == "a b c"]
    assert same[0] == same[1]
    assert M.mix(df.limit(0), some)[0].count() == 0


def test_factors_keep_clean_documents(spark):
    docs = C.read(spark, SF, "documents")
    out, model, fit = M.mix(docs, M.label_domains(C.read(spark, SF, "labels"), docs), factors={"poor": 0.3, "": 1.1})
    assert abs(sum(fit.totals) / sum(fit.wanted) - 1) < 1e-3


def test_only_the_thinned_domain_loses_copies(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.6, 0.3, 0.2], 300)  # soft: many clean rows with a share of poor
    tokens = rng.integers(1, 500, 300)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>")
    targets = {"a": 0.3, "b": 0.67, "poor": 0.03}
    fit = M.fit_rates(rows, ["a", "b", "poor"], targets, thin="poor", rounds=30)
    free = M.fit_rates(rows, ["a", "b", "poor"], targets, rounds=30)
    rate = lambda f: np.array([r[0] for r in rows.select(f.rate(F.col("posterior"))).collect()])
    judged = p[:, 2] > 0.5
    assert rate(free)[~judged].min() < 1 <= rate(fit)[~judged].min() and rate(fit)[judged].min() < 1
    natural, wanted = tokens @ p, np.array(fit.wanted)
    assert np.all(wanted[:2] >= natural[:2] - 1e-6) and np.allclose(wanted / wanted.sum(), [0.3, 0.67, 0.03])
    gram, least = (p * tokens[:, None]).T @ p, np.where(judged, 0.0, 1.0)
    r = np.maximum(least, wanted.sum() / tokens.sum())
    for _ in range(30):
        r = np.maximum(least, r - p @ np.linalg.solve(gram, (r * tokens) @ p - wanted))
    assert np.allclose(fit.gap(), (r * tokens) @ p - wanted, atol=1e-3 * wanted.sum())

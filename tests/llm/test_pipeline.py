import corpus_pipeline as P
from bastion.llm import common as C
from bastion.llm import tiling as G

from .helpers import SF, components, table


def test_stages_one_by_one(spark):
    docs = C.read(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_join", "decontamination", "source_mixing", "sharding"]
    before, kept = docs, []
    for name, step in P.STAGES:
        after = C.stage(step(spark, before, SF), f"test_{name}")
        assert after.columns[:len(columns)] == columns and (name == "sharding") == (len(after.columns) > len(columns))
        kept.append([r.asDict() for r in after.collect()])
        before = after
    source = table("documents")
    letters = [r for r in source if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(r["doc_id"] for r in letters)
    named = components([r["text"] for r in letters], [r["doc_id"] for r in letters])
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(set(named))
    leaks = {r["id"] for r in G.contaminated(docs, C.read(spark, SF, "benchmark")).collect()}
    assert leaks and sorted(r["doc_id"] for r in kept[2]) == sorted(set(named) - leaks)
    clean = {r["doc_id"] for r in table("labels") if r["quality"] == 1 and r["toxic"] == 0} & {r["doc_id"] for r in kept[2]}
    mixed = {r["doc_id"] for r in kept[3]}
    assert mixed <= {r["doc_id"] for r in kept[2]} and clean <= mixed
    assert sorted(r["doc_id"] for r in kept[4]) == sorted(r["doc_id"] for r in kept[3])
    sizes = [sum(r["shard"] == s for r in kept[4]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_stages_take_odd_rows(spark, make_docs):
    texts = [None, "", "12 34", "the cat sat on the mat today", "the cat sat on the mat today", "x" * 200000]
    odd = make_docs(texts, langs=[None, "en", "en", "en", None, "en"], ids=[None, 1, 2, 3, 3, None])
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, step in P.STAGES:
            docs = C.stage(step(spark, docs, SF), "odd")
        docs.collect()


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(E.oracle_sql()) <= names


def test_mixing_goes_to_target_weights_and_keeps_clean_documents(spark):
    from bastion.llm import mixing as M
    sf = "/root/testdata/sf0.01"
    docs = C.read(spark, sf, "documents")
    left = {r["doc_id"] for r in P.source_mixing(spark, docs, sf).select("doc_id").distinct().collect()}
    clean = {r["doc_id"] for r in table("labels", sf) if r["quality"] == 1}
    lost = clean & {r["doc_id"] for r in table("documents", sf)} - left
    assert clean and not lost
    mixed, model, fit = M.mix(docs, M.label_domains(C.read(spark, sf, "labels"), docs), thin=P.THIN)
    rows = mixed.select("posterior", "rate", "copies").collect()
    poor = model.domains.index("poor")
    assert all(r["rate"] >= 1 and r["copies"] >= 1 for r in rows if r["posterior"][poor] <= 0.5)
    weights = [M.TARGETS[d] for d in model.domains]
    print({d: (round(t), round(w), round(g)) for d, t, w, g in zip(model.domains, fit.totals, fit.wanted, fit.gap())}, sum(fit.totals))
    assert all(abs(t / sum(fit.totals) - w) < 0.03 for t, w in zip(fit.totals, weights))


def test_columns_of_the_operators_names_pass_through(spark):
    from pyspark.sql import functions as F
    docs = C.read(spark, SF, "documents").withColumn("tokens", F.concat(F.lit("t"), F.col("doc_id"))).withColumn("rate", F.lit("mine")).withColumn(
        "copies", F.lit(None).cast("string")).withColumn("posterior", F.lit(3))
    out = P.source_mixing(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    got = out.select("doc_id", "tokens", "rate", "copies", "posterior").distinct().collect()
    assert got and all((r["tokens"], r["rate"], r["copies"], r["posterior"]) == (f"t{r['doc_id']}", "mine", None, 3) for r in got)

"""A corpus pipeline of five stages over ``documents``, each one of the operators of ``bastion.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
it is written as Parquet in the shared folder and read again as the next stage's docs, so a lost executor
costs a part of one stage. All but the last return the columns of documents.

1. language_id: documents without a language (null text, no letters) go.
2. jaccard_join: one document of each near-duplicate component stays.
3. decontamination: documents that hold benchmark items go.
4. mixing: documents get copies by rates fitted to the target weights of the domains: low quality is thinned out,
   documents not judged poor have one copy at least. A document with two copies is two rows.
5. sharding: the rest is shuffled uniformly into 24 shards of equal size (columns shard, slot).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastion.llm import common, langid, mixing, prefixjoin, shard, tiling

#: The domain that the mixing stage thins out; all others keep every document.
THIN = "poor"
log = logging.getLogger(__name__)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.classify(docs, langid.fit(docs), pred_col="__lang_pred", score_col="__lang_score")
    return found.where(F.col("__lang_pred") != langid.UNKNOWN).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefixjoin.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = tiling.with_coverage(docs, common.read(spark, sf_dir, "benchmark"), out_col="__coverage")
    return found.where(F.col("__coverage") < tiling.COVER).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(common.read(spark, sf_dir, "labels"), docs)
    # the caller's columns of these names pass through under others
    own = {c: f"__own_{c}" for c in docs.columns if c in mixing.ADDED}
    mixed, model, fitted = mixing.mix(docs.withColumnsRenamed(own), labels, targets=mixing.TARGETS, thin=THIN)
    for domain, wanted, gap in zip(model.domains, fitted.wanted, fitted.gap()):
        log.info("mixing: %s wants %.0f expected tokens, gap %+.0f", domain, wanted, gap)
    dealt = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return dealt.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    return shard.shuffle_into_shards(marked, ["doc_id", "__mark"]).drop("__mark")


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("sharding", sharding)]

#: Kernel regression, tiling and random draws are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave, with shard and slot."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        before, docs = docs, step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name)
            common.unstage(before)
    return docs

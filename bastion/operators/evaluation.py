"""Synthetic retrieval, answer join with fallback, per-question scores, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.overlap import f1_of_sets, mean_f1_of_sets, recall_of_sets, share_of_set
from ..functions.text import token_set


def mock_retrieve(samples: DataFrame) -> DataFrame:
    """Template answer and single context from question, truth, keywords, domain."""
    kw_all = F.array_join("contexts_keywords", ", ")
    kw_two = F.array_join(F.slice("contexts_keywords", 1, 2), ", ")
    ctx = F.concat(F.lit("Question: "), F.col("question"), F.lit(" Grounded answer: "), F.col("ground_truth"),
                   F.lit(" Relevant terms: "), kw_all, F.lit(". Department: "), F.col("domain"), F.lit("."))
    ans = F.concat(F.lit("Question: "), F.col("question"), F.lit(" Answer: "), F.col("ground_truth"),
                   F.lit(" Relevant terms: "), kw_two, F.lit("."))
    return samples.withColumn("mock_answer", ans).withColumn("mock_contexts", F.array(ctx))


def attach_answers(samples: DataFrame, answers: DataFrame | None, key: str = "sample_id") -> DataFrame:
    """Left join retrieved (answer, contexts) per sample; missing -> E6 mock.

    ``answers`` is the output of a retrieval run (or None for a dry run). The join
    is on the sample key; AQE broadcasts whichever side is small at run time.
    """
    s = mock_retrieve(samples)
    if answers is None:
        return s.withColumn("answer", F.col("mock_answer")).withColumn("contexts", F.col("mock_contexts")) \
            .withColumn("mode", F.lit("dry_run"))
    a = answers.select(key, F.col("answer").alias("__ans"), F.col("contexts").alias("__ctx"))
    j = s.join(a, key, "left")
    live = F.col("__ans").isNotNull()
    return (j.withColumn("answer", F.when(live, F.col("__ans")).otherwise(F.col("mock_answer")))
             .withColumn("contexts", F.when(live, F.col("__ctx")).otherwise(F.col("mock_contexts")))
             .withColumn("mode", F.when(live, F.lit("live")).otherwise(F.lit("fallback")))
             .drop("__ans", "__ctx"))


def per_question(scored_in: DataFrame) -> DataFrame:
    """E2-E5 + E8: the four metrics per sample, answer cut to 200 characters."""
    # every text is tokenised once, in a projection of its own
    texts = scored_in.withColumns({
        "__q": token_set("question"), "__a": token_set("answer"), "__t": token_set("ground_truth"),
        "__c": token_set(F.array_join("contexts", " ")), "__cs": F.transform("contexts", token_set)})
    return texts.select(
        "sample_id", "question", "domain", "role",
        F.substring("answer", 1, L.EVAL_ANSWER_CHARS).alias("answer"),
        share_of_set("__a", "__c").alias("faithfulness"),
        F.bround(f1_of_sets(F.col("__q"), F.col("__a")), 3).alias("answer_relevancy"),
        mean_f1_of_sets("__q", "__cs").alias("context_precision"),
        recall_of_sets("__t", "__c", "__cs").alias("context_recall"),
    )


METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def mean_3dp(metric: str):
    """Mean of 3-dp values rounded half-even to 3 dp, in exact integer arithmetic.

    The metrics are already rounded to 3 dp, so they are summed as integer
    thousandths; the quotient is rounded with integer division. No floating
    summation order can move a result across a rounding tie.
    """
    s = F.sum(F.round(F.col(metric) * 1000).cast("long"))
    n = F.count(F.col(metric))
    q = F.floor(s / n).cast("long")
    rem2 = (s - q * n) * 2
    r = F.when(rem2 > n, q + 1).when((rem2 == n) & (F.pmod(q, F.lit(2)) == 1), q + 1).otherwise(q)
    return F.when(n > 0, r / F.lit(1000.0))


def summary(per_q: DataFrame, threshold: float = L.EVAL_THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """Mean of each (already rounded) metric to 3 dp; passed iff all >= threshold.

    A global aggregate (partial per partition, one tiny final step) — optionally per
    ``by`` group, e.g. domain.
    """
    g = per_q.groupBy(*(by or []))
    a = g.agg(F.count(F.lit(1)).alias("total_questions"),
              *[mean_3dp(m).alias(f"avg_{m}") for m in METRICS])
    return a.withColumn("threshold", F.lit(float(threshold))).withColumn(
        "passed", F.least(*[F.col(f"avg_{m}") for m in METRICS]) >= F.lit(float(threshold)))


def report(per_q: DataFrame, threshold: float = L.EVAL_THRESHOLD, mode: str = "dry_run") -> DataFrame:
    """S10 shape: the one-row summary with mode and time; the per-question rows stay a table beside it."""
    return summary(per_q, threshold).withColumn("mode", F.lit(mode)).withColumn("run_timestamp", F.current_timestamp())

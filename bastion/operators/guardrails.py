"""Input and output guard pipelines and the guard split.

All are narrow projections over a text column: no shuffle, no Python. Each check
is projected once into a struct column; the pipeline outcome reads struct fields,
so no regex is evaluated twice per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.guards import detect_injection, pii_detected, pii_hits, pii_redact, scope_check
from ..functions.text import sha256_prefix


def _pii_struct(text_col: str, hits_col: str, unicode: bool):
    detected = pii_detected(F.col(hits_col))
    return F.struct(
        (F.size(detected) > 0).alias("has_pii"),
        detected.alias("detected"),
        pii_redact(F.col(text_col), F.col(hits_col), unicode).alias("redacted_text"),
    )


def with_pii(df: DataFrame, text: str, out: str = "pii", unicode: bool = True) -> DataFrame:
    """G1+G3: add ``out`` = struct(has_pii, detected, redacted_text)."""
    hits = f"__{out}_hits"
    return (df.withColumn(hits, pii_hits(text, unicode))
              .withColumn(out, _pii_struct(text, hits, unicode)).drop(hits))


def check_input(df: DataFrame, text: str = "query", block_on_pii: bool = True,
                company: str = L.DEFAULT_COMPANY, assistant: str = L.DEFAULT_ASSISTANT,
                out: str = "guard", unicode: bool = True) -> DataFrame:
    """Fast-fail injection -> PII -> scope over ``text``.

    Adds ``out`` = struct(passed, block_type, blocked_reason, sanitized_input,
    injection, pii, scope). With ``block_on_pii=False`` (G6b) PII is redacted and
    the scope check runs on the redacted text.
    """
    df = df.withColumn("__inj", detect_injection(text, unicode))
    # a later check runs only on rows that are still open
    open_pii = ~F.coalesce(F.col("__inj.is_injection"), F.lit(False))
    df = df.withColumn("__pii_hits", F.when(open_pii, pii_hits(text, unicode)))
    df = df.withColumn("__pii", F.when(open_pii, _pii_struct(text, "__pii_hits", unicode))).drop("__pii_hits")
    has_pii = F.coalesce(F.col("__pii.has_pii"), F.lit(False))
    pii_block = has_pii if block_on_pii else F.lit(False)
    open_scope = open_pii & ~pii_block
    forward = F.col(text) if block_on_pii else F.when(has_pii, F.col("__pii.redacted_text")).otherwise(F.col(text))
    df = df.withColumn("__fwd", forward)
    df = df.withColumn("__scope", F.when(open_scope, scope_check("__fwd", company, assistant, unicode)))
    inj_hit = ~open_pii
    scope_miss = ~F.coalesce(F.col("__scope.in_scope"), F.lit(True))
    block_type = (F.when(inj_hit, F.lit("INJECTION")).when(pii_block, F.lit("PII"))
                  .when(scope_miss, F.lit("SCOPE")).otherwise(F.lit("")))
    reason = (
        F.when(inj_hit, F.concat(F.lit(L.MSG_INJECTION.split("{attack}")[0]), F.col("__inj.attack_type"),
                                 F.lit(L.MSG_INJECTION.split("{attack}")[1])))
        .when(pii_block, F.concat(F.lit(L.MSG_PII.split("{types}")[0]),
                                  F.array_join(F.col("__pii.detected"), ", "),
                                  F.lit(L.MSG_PII.split("{types}")[1])))
        .when(scope_miss, F.concat(F.lit(L.MSG_SCOPE.split("{reason}")[0].format(assistant=assistant)),
                                   F.col("__scope.reason")))
        .otherwise(F.lit(""))
    )
    sanitized = (F.when(inj_hit, F.lit("")).when(pii_block, F.col("__pii.redacted_text"))
                 .when(scope_miss, F.lit("")).otherwise(F.col("__fwd")))
    passed = block_type == ""
    # the nested results: of the check that blocked, or of all three when passed
    df = df.withColumn(out, F.struct(
        passed.alias("passed"),
        block_type.alias("block_type"),
        reason.alias("blocked_reason"),
        sanitized.alias("sanitized_input"),
        F.when(inj_hit | passed, F.col("__inj")).alias("injection"),
        F.when((block_type == "PII") | passed, F.col("__pii")).alias("pii"),
        F.when((block_type == "SCOPE") | passed, F.col("__scope")).alias("scope"),
    ))
    return df.drop("__inj", "__pii", "__fwd", "__scope")


def check_output(df: DataFrame, text: str = "answer", out: str = "out_guard", unicode: bool = True) -> DataFrame:
    """Never blocks; PII in the answer is redacted and reported as OUTPUT_PII."""
    df = with_pii(df, text, "__opii", unicode)
    has = F.col("__opii.has_pii")
    head, tail = L.MSG_OUTPUT_PII.split("{types}")
    df = df.withColumn(out, F.struct(
        F.lit(True).alias("passed"),
        F.when(has, F.lit("OUTPUT_PII")).otherwise(F.lit("")).alias("block_type"),
        F.when(has, F.concat(F.lit(head), F.array_join(F.col("__opii.detected"), ", "), F.lit(tail)))
        .otherwise(F.lit("")).alias("blocked_reason"),
        F.when(has, F.col("__opii.redacted_text")).otherwise(F.col(text)).alias("sanitized_input"),
        F.col("__opii").alias("pii"),
    ))
    return df.drop("__opii")


def guard_split(guarded: DataFrame, message: str = "query", guard: str = "guard",
                ts: str | None = None, materialized: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocked rows -> (events, metrics); passed rows -> forwarded with ``safe_query``.

    Returns ``(forwarded, guardrail_events, blocked_metrics)``. A filter on the
    guard struct would be pushed below the projection that computes it (alias
    substitution), running every regex twice; and three outputs read the same
    rows. So the guarded frame is checkpointed once here, unless the caller says
    it already is (``materialized``, e.g. a persisted micro-batch).
    """
    if not materialized:
        from ..session import materialize
        guarded = materialize(guarded)
    tcol = F.col(ts) if ts else F.current_timestamp()
    blocked = guarded.where(~F.col(f"{guard}.passed"))
    events = blocked.select(
        tcol.alias("timestamp"), "username", "role",
        F.col(f"{guard}.block_type").alias("event_type"),
        F.col(f"{guard}.blocked_reason").alias("reason"),
        sha256_prefix(F.col(message), L.QUERY_HASH_HEX_CHARS).alias("query_hash"),
    )
    metrics = blocked.select(
        tcol.alias("timestamp"), "username", "role",
        F.lit("none").alias("model_used"), F.lit("blocked").alias("complexity"),
        F.lit(0.0).alias("latency_ms"), F.lit(0).alias("tokens_used"), F.lit(0.0).alias("cost_usd"),
        F.lit(False).alias("cache_hit"), F.lit(True).alias("guardrail_triggered"),
        F.col(f"{guard}.blocked_reason").alias("guardrail_reason"),
    )
    sanitized = F.col(f"{guard}.sanitized_input")
    forwarded = guarded.where(F.col(f"{guard}.passed")).withColumn(
        "safe_query", F.coalesce(F.when(sanitized != "", sanitized), F.col(message)))
    return forwarded, events, metrics

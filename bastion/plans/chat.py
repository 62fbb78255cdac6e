"""The chat request path as one DataFrame DAG over a table of requests.

guard (G6/G8) -> cache (C1) -> route (T1/T2) -> hypothesis (V7) -> access-filtered
top-k (R2/V5) -> rerank (V8) -> context, prompt, sources (V10-V12) -> answer join
-> output guard (G7) -> tokens and cost (T3/T4) -> outcome rows (V14).

Every request ends in exactly one outcome — blocked, cached, no_documents, failed (no
answer came) or completed — and the branches are unioned by name into one schema. Sinks
are filters on ``outcome`` (see :func:`sinks`). Answers and hypotheses arrive as
tables; embeddings come from a pluggable function (default: Spark ML hashing).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.overlap import token_f1
from ..functions.routing import cost_usd, estimate_tokens
from ..operators import cache as C
from ..operators import retrieval as R
from ..operators.guardrails import check_input, check_output
from ..operators.routing import route
from ..operators.vectors import hashing_embedder
from ..session import materialize

OUTCOME_COLS = ["query_id", "ts", "username", "role", "query", "response", "sources", "chunk_ids", "model_used",
                "complexity", "cache_hit", "guardrail_triggered", "guardrail_reason", "block_type", "hyde_used",
                "rerank_used", "tokens_used", "cost_usd", "latency_ms", "outcome", "safe_query", "entry_id"]


@dataclass
class ChatConfig:
    k_candidates: int = L.RERANK_CANDIDATES
    top_k: int = L.RERANK_TOP_K
    rerank: bool = True
    provider: str | None = None
    overrides: dict | None = None
    block_on_pii: bool = True
    ttl_s: float = L.CACHE_TTL_SECONDS
    threshold: float = L.CACHE_THRESHOLD
    search: dict | None = None  # arguments of R.retrieve, e.g. {"method": "lsh", "dim": 384, "bits": 12}


def _typed(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("query_id").cast("long"), F.col("ts"), "username", "role", "query", F.col("response").cast("string"),
        F.col("sources").cast("array<string>"), F.col("chunk_ids").cast("array<string>"),
        F.col("model_used").cast("string"), F.col("complexity").cast("string"), F.col("cache_hit").cast("boolean"),
        F.col("guardrail_triggered").cast("boolean"), F.col("guardrail_reason").cast("string"),
        F.col("block_type").cast("string"), F.col("hyde_used").cast("boolean"), F.col("rerank_used").cast("boolean"),
        F.col("tokens_used").cast("int"), F.col("cost_usd").cast("double"),
        F.col("latency_ms").cast("double"), F.col("outcome").cast("string"),
        F.col("safe_query").cast("string"), F.col("entry_id").cast("long"))


def chat(requests: DataFrame, chunks: DataFrame, answers: DataFrame, *, cache_entries: DataFrame | None = None,
         hypotheses: DataFrame | None = None, embed: Callable[[DataFrame, str, str], DataFrame] = hashing_embedder,
         scorer: Callable[[DataFrame], DataFrame] | None = None, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """Run P1. ``requests``: query_id, ts, username, role, query. ``chunks``: chunk_id,
    namespace, vec, text, source. ``answers``: query_id, answer, latency_ms (a request without a
    row, or with a NULL answer, has failed). ``cache_entries``:
    entry_id, vec, created_at, owner_role, response, sources, model_used.
    ``scorer`` adds a ``score`` column to (query_id, safe_query, chunk_id, text)
    candidate rows; the default is token-overlap F1 (E1)."""
    # fan-out points (guard result, embedded requests, candidates) are staged once, with the
    # columns that are read later, so the outcome branches never replay regex or embedding work
    g = check_input(requests.select("query_id", "ts", "username", "role", "query"), "query", block_on_pii=cfg.block_on_pii)
    g = materialize(g.withColumn("guard", F.struct("guard.passed", "guard.blocked_reason", "guard.block_type", "guard.sanitized_input")))
    blocked = g.where(~F.col("guard.passed")).select(
        "query_id", "ts", "username", "role", "query",
        F.concat(F.lit("Warning: "), F.col("guard.blocked_reason")).alias("response"),
        F.array().alias("sources"), F.array().alias("chunk_ids"), F.lit("none").alias("model_used"),
        F.lit("blocked").alias("complexity"), F.lit(False).alias("cache_hit"), F.lit(True).alias("guardrail_triggered"),
        F.col("guard.blocked_reason").alias("guardrail_reason"), F.col("guard.block_type").alias("block_type"),
        F.lit(False).alias("hyde_used"), F.lit(False).alias("rerank_used"), F.lit(0).alias("tokens_used"),
        F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_ms"), F.lit("blocked").alias("outcome"), F.lit(None).alias("safe_query"),
        F.lit(None).alias("entry_id"))
    san = F.col("guard.sanitized_input")
    passed = g.where(F.col("guard.passed")).select(
        "query_id", "ts", "username", "role", "query",
        F.coalesce(F.when(san != "", san), F.col("query")).alias("safe_query"))
    passed = materialize(embed(passed, "safe_query", "vec"))

    # -- cache ---------------------------------------------------------------
    if cache_entries is not None:
        cache_entries = materialize(cache_entries)  # counted by time, searched, and read again for the hits
        lk = C.lookup(passed.select("query_id", "vec", "ts", "role"), cache_entries, ttl_s=cfg.ttl_s,
                      threshold=cfg.threshold)
        passed = materialize(passed.join(lk.select("query_id", "entry_id", "hit"), "query_id", "left"))
        ent = cache_entries.select("entry_id", F.col("response").alias("c_response"),
                                   F.col("sources").alias("c_sources"), F.col("model_used").alias("c_model"))
        hits = passed.where(F.col("hit")).join(ent, "entry_id", "left")
        cached = hits.select(
            "query_id", "ts", "username", "role", "query", F.col("c_response").alias("response"),
            F.col("c_sources").alias("sources"), F.array().alias("chunk_ids"), F.col("c_model").alias("model_used"),
            F.lit("cached").alias("complexity"), F.lit(True).alias("cache_hit"),
            F.lit(False).alias("guardrail_triggered"), F.lit("").alias("guardrail_reason"), F.lit("").alias("block_type"),
            F.lit(False).alias("hyde_used"), F.lit(False).alias("rerank_used"), F.lit(0).alias("tokens_used"),
            F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_ms"), F.lit("cached").alias("outcome"), "safe_query", "entry_id")
        misses = passed.where(~F.coalesce(F.col("hit"), F.lit(False))).drop("hit", "entry_id")
    else:
        cached = None
        misses = passed

    # -- route, hypothesis, retrieve -------------------------------------------
    routed = route(misses, "safe_query", "role", provider=cfg.provider, overrides=cfg.overrides)
    routed = R.hypothesis(routed, hypotheses, "query_id", "safe_query", "text")
    if hypotheses is not None:
        # embed only the rows whose retrieval text changed; the query vector is reused otherwise
        hyp = embed(routed.where(F.col("hyde_used")).select("query_id", "retrieval_text"), "retrieval_text", "hvec")
        routed = routed.join(hyp.select("query_id", "hvec"), "query_id", "left").withColumn(
            "vec", F.coalesce(F.col("hvec"), F.col("vec"))).drop("hvec")
    k = cfg.k_candidates if cfg.rerank else cfg.top_k
    routed = materialize(routed)
    # namespaces, counts by namespace and the search read the chunks' vectors: they are cut and embedded once
    searched = materialize(chunks.select("chunk_id", "namespace", "vec"))
    cand = materialize(R.retrieve(routed.select("query_id", "role", "vec"), searched, k, **(cfg.search or {})))
    nodoc = R.no_documents(routed, cand)
    no_documents = nodoc.select(
        "query_id", "ts", "username", "role", "query", "response", "sources", F.array().alias("chunk_ids"),
        F.col("model_name").alias("model_used"), "complexity", F.lit(False).alias("cache_hit"),
        F.lit(False).alias("guardrail_triggered"), F.lit("").alias("guardrail_reason"), F.lit("").alias("block_type"),
        "hyde_used", F.lit(False).alias("rerank_used"), F.lit(0).alias("tokens_used"), F.lit(0.0).alias("cost_usd"),
        F.lit(0.0).alias("latency_ms"), F.lit("no_documents").alias("outcome"), "safe_query", F.lit(None).alias("entry_id"))

    # -- rerank, context, prompt ---------------------------------------------------
    cand = cand.join(routed.select("query_id", "safe_query"), "query_id").join(
        chunks.select("chunk_id", "text", "source"), "chunk_id")
    if cfg.rerank:
        scored = scorer(cand) if scorer else cand.withColumn("score", token_f1("safe_query", "text"))
        ranked = R.rerank(scored, cfg.top_k)
    else:
        ranked = cand.withColumn("rank", F.col("retrieval_rank")).withColumn("rerank_used", F.lit(False))
    used = ranked.groupBy("query_id").agg(F.max("rerank_used").alias("rerank_used"))
    ctx = R.assemble(ranked).join(used, "query_id")
    done = routed.join(ctx, "query_id")
    done = R.build_prompt(done)

    # -- answer, output guard, cost -----------------------------------------------
    done = done.join(answers.select("query_id", "answer", "latency_ms"), "query_id", "left")
    broken = done.where(F.col("answer").isNull())
    failed = broken.select(
        "query_id", "ts", "username", "role", "query", F.lit("").alias("response"), "sources", "chunk_ids",
        F.col("model_name").alias("model_used"), "complexity", F.lit(False).alias("cache_hit"),
        F.lit(False).alias("guardrail_triggered"), F.lit("").alias("guardrail_reason"), F.lit("").alias("block_type"),
        "hyde_used", "rerank_used", F.lit(0).alias("tokens_used"), F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_ms"),
        F.lit("failed").alias("outcome"), "safe_query", F.lit(None).alias("entry_id"))
    done = check_output(done.where(F.col("answer").isNotNull()), "answer")
    done = done.withColumn("tokens_used", estimate_tokens(F.concat(F.col("prompt"), F.col("answer"))))
    completed = done.select(
        "query_id", "ts", "username", "role", "query", F.col("out_guard.sanitized_input").alias("response"),
        "sources", "chunk_ids", F.col("model_name").alias("model_used"), "complexity",
        F.lit(False).alias("cache_hit"), F.lit(False).alias("guardrail_triggered"),
        F.lit("").alias("guardrail_reason"), F.col("out_guard.block_type").alias("block_type"),
        "hyde_used", "rerank_used", "tokens_used", cost_usd("tokens_used", "model_name").alias("cost_usd"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.lit("completed").alias("outcome"), "safe_query", F.lit(None).alias("entry_id"))

    parts = [blocked, no_documents, failed, completed] + ([cached] if cached is not None else [])
    out = _typed(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_typed(p))
    return out


def sinks(outcomes: DataFrame) -> dict[str, DataFrame]:
    """V14 sink rows: metrics (blocked, cached, completed), chats (completed),
    guardrail events (blocked), cache puts (completed). A failed request is in none."""
    from ..functions.text import sha256_prefix
    metrics = outcomes.where(F.col("outcome").isin("blocked", "cached", "completed")).select(
        F.col("query_id").alias("id"), "ts", "username", "role", "model_used", "complexity",
        "latency_ms", "tokens_used", "cost_usd", "cache_hit", "guardrail_triggered", "guardrail_reason")
    chats = outcomes.where(F.col("outcome") == "completed").select(
        F.col("query_id").alias("chat_id"), "ts", "username", "role", "query", F.col("response").alias("answer"),
        "chunk_ids", "model_used", "latency_ms", "cache_hit")
    events = outcomes.where(F.col("outcome") == "blocked").select(
        "ts", "username", "role", F.col("block_type").alias("event_type"), F.col("guardrail_reason").alias("reason"),
        sha256_prefix("query", L.QUERY_HASH_HEX_CHARS).alias("query_hash"))
    puts = outcomes.where(F.col("outcome") == "completed").select(
        F.col("query_id").alias("entry_id"), F.col("safe_query").alias("query"), "response", "sources", "model_used",
        F.col("role").alias("owner_role"), F.col("ts").alias("created_at"), F.lit(0).alias("hits"))
    return {"query_metrics": metrics, "chat_logs": chats, "guardrail_events": events, "cache_puts": puts}

"""Access-filtered retrieval, hypothesis expansion, rerank, context assembly.

Per-query groups here are bounded by k (top-k candidates), so the ordered
``collect_list`` aggregations never gather an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import col_of, strip
from .access import principal_namespaces
from .vector_index import search_index
from .vectors import approx_topk, block_topk, topk_join


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = L.RERANK_CANDIDATES, *, q_id: str = "query_id",
             role: str = "role", q_vec: str = "vec", c_id: str = "chunk_id", c_vec: str = "vec",
             namespace: str = "namespace", method: str = "block", **kw) -> DataFrame:
    """V5: k nearest chunks among those the query's role may read (R2 before distance).

    Queries are expanded to one row per readable namespace (R1; the unrestricted
    role gets every namespace present) and equi-joined on namespace, so the
    access filter is a join key, never an OR predicate. ``method``: ``block`` (exact,
    blocked kernel), ``index`` (V6: a persisted index of the chunks, given as ``index``; exact unless ``probes``
    limits it), ``lsh`` (approximate without an index, needs ``dim``; only chunks of a readable
    namespace are candidates) or ``join`` (exact, every pair a row: for checks).
    Returns (q_id, c_id, score, retrieval_rank).
    """
    q = principal_namespaces(queries.select(q_id, role, q_vec), chunks, role, namespace)
    if method == "block":
        res = block_topk(q, chunks, k, q_id=q_id, i_id=c_id, q_key=namespace, i_key=namespace, q_vec=q_vec,
                         i_vec=c_vec, bounded_keys=True, **kw)
    elif method == "lsh":
        res = approx_topk(q, chunks, k, q_id=q_id, i_id=c_id, q_key=namespace, i_key=namespace, q_vec=q_vec,
                          i_vec=c_vec, **kw).select(q_id, c_id, "score", "rank")
    elif method == "index":
        res = search_index(q, kw.pop("index"), k, q_id=q_id, i_id=c_id, q_key=namespace, q_vec=q_vec, **kw)
    elif method != "join":
        raise ValueError(f"unknown method {method!r}")
    else:
        res = topk_join(q, chunks, k, q_id=q_id, i_id=c_id, key=namespace, q_vec=q_vec, i_vec=c_vec, **kw)
    return res.withColumnRenamed("rank", "retrieval_rank")


def hypothesis(queries: DataFrame, hypotheses: DataFrame | None, key: str = "query_id", query: str = "query",
               text: str = "text") -> DataFrame:
    """V7: retrieval text = the generated passage if non-blank, else the query.

    Adds ``hyde_prompt`` (the prompt a generator would receive), ``retrieval_text``
    and ``hyde_used``. Passages arrive as a table (left join on the query key).
    """
    head, tail = L.HYPOTHESIS_PROMPT.split("{query}")
    q = queries.withColumn("hyde_prompt", F.concat(F.lit(head), F.col(query), F.lit(tail)))
    if hypotheses is None:
        return q.withColumn("retrieval_text", F.col(query)).withColumn("hyde_used", F.lit(False))
    h = hypotheses.select(key, strip(F.col(text)).alias("__hyp"))
    j = q.join(h, key, "left")
    rt = F.coalesce(F.when(F.col("__hyp") != "", F.col("__hyp")), F.col(query))
    return j.withColumn("retrieval_text", rt).withColumn("hyde_used", F.col("retrieval_text") != F.col(query)) \
        .drop("__hyp")


def rerank(candidates: DataFrame, k: int = L.RERANK_TOP_K, *, q_id: str = "query_id", score: str = "score",
           retrieval_rank: str = "retrieval_rank", keep_scores: bool = False) -> DataFrame:
    """V8/V9: order each query's candidates by score desc (ties keep retrieval order), keep k.

    Rerank applies only when a query has more than k candidates; otherwise the
    retrieval order is kept. NULL scores (scorer missing or failed) sort last,
    which reproduces the fallback "original order cut to k". With
    ``keep_scores`` the score is kept, 0.0 where NULL (V9).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(q_id))
    c = candidates.withColumn("rerank_used", n > k)
    order = Window.partitionBy(q_id).orderBy(
        F.when(F.col("rerank_used"), F.col(score)).desc_nulls_last(), F.col(retrieval_rank))
    out = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if keep_scores:
        out = out.withColumn("rerank_score", F.coalesce(F.col(score), F.lit(0.0)))
    return out


def ordered_list(value: Column | str, rank: Column | str) -> Column:
    """Aggregate: values ordered by rank (struct sort), for bounded per-query groups."""
    s = F.array_sort(F.collect_list(F.struct(col_of(rank).alias("r"), col_of(value).alias("v"))))
    return F.transform(s, lambda x: x["v"])


def assemble(ranked: DataFrame, *, q_id: str = "query_id", rank: str = "rank", text: str = "text",
             source: str = "source", c_id: str = "chunk_id") -> DataFrame:
    """V10 + V12: per query the context (texts in rank order joined by the separator),
    source list ('unknown' if missing), chunk-id list ('' if missing) and distinct sources."""
    g = ranked.groupBy(q_id).agg(
        ordered_list(text, rank).alias("__texts"),
        ordered_list(F.coalesce(F.col(source), F.lit("unknown")), rank).alias("sources"),
        ordered_list(F.coalesce(F.col(c_id).cast("string"), F.lit("")), rank).alias("chunk_ids"),
    )
    return g.withColumn("context", F.array_join("__texts", L.CONTEXT_SEPARATOR)) \
        .withColumn("display_sources", F.array_distinct("sources")).drop("__texts")


def build_prompt(df: DataFrame, *, role: str = "role", context: str = "context", query: str = "safe_query",
                 assistant: str = L.DEFAULT_ASSISTANT, company: str = L.DEFAULT_COMPANY) -> DataFrame:
    """The answer prompt as a template column."""
    t = L.ANSWER_PROMPT.replace("{assistant}", assistant).replace("{company}", company)
    a, rest = t.split("{role}")
    b, rest = rest.split("{context}")
    c, d = rest.split("{query}")
    return df.withColumn("prompt", F.concat(F.lit(a), F.col(role), F.lit(b), F.col(context), F.lit(c),
                                            F.col(query), F.lit(d)))


def no_documents(queries: DataFrame, retrieved: DataFrame, q_id: str = "query_id") -> DataFrame:
    """Queries with no readable chunk at all -> fixed message, empty sources."""
    return queries.join(retrieved.select(q_id).distinct(), q_id, "left_anti").withColumn(
        "response", F.lit(L.MSG_NO_DOCUMENTS)).withColumn("sources", F.array().cast("array<string>"))

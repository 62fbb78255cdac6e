"""Registered vector, retrieval and cache queries (V1-V13, C1-C5, C7) over embeddings/documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.overlap import f1_of_sets
from ..functions.text import hashed_token_set
from ..operators import cache as C
from ..operators import retrieval as R
from ..operators.access import principal_namespaces
from ..operators.vector_index import build_index, candidates
from ..operators.vectors import cosine, hashing_embedder, norm
from ..operators.ingest import fixed_chunks
from ..sources.driver_tables import chat_answers, chat_queries, pair_id, sql_pair_id, table, vectors, with_sql
from ..session import materialize, scratch
from . import duck as D

THRESHOLD = 0.3  # the synthetic vectors never reach 0.95; 0.3 gives real hits
TTL = L.CACHE_TTL_SECONDS


def _vec(spark, sf):
    return vectors(table(spark, sf, "embeddings"))


def _chunk_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "text", "source")


# -- V1/V2 ---------------------------------------------------------------------
def v1_chunks(spark, sf):
    ch = fixed_chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return ch.select("doc_id", "pos", "chunk_id", "start", F.length("chunk_text").alias("chunk_len"),
                     F.sha2("chunk_text", 256).alias("chunk_sha256"))


V1_SQL = """WITH s AS (
  SELECT doc_id, text, unnest(generate_series(1, greatest(1, length(text) - 50), 450)) AS start
  FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
             CAST(start AS INTEGER) AS start, substr(text, start, 500) AS chunk_text FROM s)
SELECT doc_id, pos, sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS chunk_id, start,
       CAST(length(chunk_text) AS INTEGER) AS chunk_len, sha256(chunk_text) AS chunk_sha256 FROM c"""


# -- V3 ----------------------------------------------------------------------
EMBED_DIM = 256


def v3_embed(spark, sf):
    """The default embedding of every whole document: its length, its norm (1, or 0 without words) and whether it matches itself.

    The values themselves are hashes of words: a brute-force version checks them in the tests.
    """
    v = hashing_embedder(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", dim=EMBED_DIM)
    return v.select("doc_id", F.size("vec").alias("dim"), F.round(norm("vec"), 6).alias("norm"), (F.round(cosine("vec", "vec"), 6) == 1.0).alias("self_similar"))


V3_SQL = rf"""SELECT doc_id, {EMBED_DIM} AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
  regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}_]') AS self_similar FROM documents"""


# -- V4 ----------------------------------------------------------------------
def v4_cosine(spark, sf):
    v = _vec(spark, sf)
    a = v.select("vec_id", F.col("vec").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine("a", "b"), 6).alias("cosine"))


def _cos_sql(a, b):
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 OR len({a}) <> len({b}) OR list_dot_product({a}, {a}) = 0 "
            f"OR list_dot_product({b}, {b}) = 0 THEN 0.0::DOUBLE ELSE list_dot_product({a}, {b}) / "
            f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")


V4_SQL = with_sql("vectors") + f"""SELECT a.vec_id, round({_cos_sql('a.vec', 'b.vec')}, 6) AS cosine
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"""


# -- V5 ----------------------------------------------------------------------
def _retrieve(spark, sf, k, method="block", **kw):
    v = _vec(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), "role", "vec")
    c = v.select(F.col("vec_id").alias("chunk_id"), "namespace", "vec")
    return R.retrieve(q, c, k, method=method, exclude_self=True, **kw)


def v5_topk(spark, sf):
    return _retrieve(spark, sf, L.RERANK_TOP_K)


def _pairs_sql():
    return with_sql("vectors") + f"""
, qn AS (
  SELECT q.vec_id AS query_id, q.vec, rn.namespace FROM vectors q JOIN {D.role_ns_dim()}
    ON {D.norm_role('q.role')} = rn.role WHERE {D.norm_role('q.role')} <> 'c-levelexecutives'
  UNION ALL SELECT q.vec_id, q.vec, 'general' FROM vectors q
    WHERE {D.norm_role('q.role')} NOT IN (SELECT role FROM {D.roles_dim()})
  UNION ALL SELECT q.vec_id, q.vec, n.namespace FROM vectors q, (SELECT DISTINCT namespace FROM vectors) n
    WHERE {D.norm_role('q.role')} = 'c-levelexecutives'),
sc AS (SELECT qn.query_id, c.vec_id AS chunk_id, round({_cos_sql('qn.vec', 'c.vec')}, 6) AS score
  FROM qn JOIN vectors c ON c.namespace = qn.namespace WHERE c.vec_id <> qn.query_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS retrieval_rank FROM sc)"""


def _v5_sql(k):
    return _pairs_sql() + f"\nSELECT query_id, chunk_id, score, CAST(retrieval_rank AS INTEGER) AS retrieval_rank FROM rk WHERE retrieval_rank <= {k}"


# -- V6 ----------------------------------------------------------------------
DIM = 64


def _index(spark, sf):
    """An index of all vectors by namespace, below the shared folder."""
    v = _vec(spark, sf)
    chunks = v.select(F.col("vec_id").alias("chunk_id"), "namespace", "vec")
    return build_index(chunks, scratch(spark, "vector-index"), DIM, i_id="chunk_id", i_key="namespace")


def v6_approx_topk(spark, sf):
    """Access-filtered top-k through the persisted index; without a limit of probes it is exact."""
    return _retrieve(spark, sf, L.RERANK_TOP_K, method="index", index=_index(spark, sf))


def v6_index_reads(spark, sf):
    """How the index was read, per query: all its readable vectors are known to it, and at most three in ten were read in full."""
    index = _index(spark, sf)
    v = _vec(spark, sf)
    q = principal_namespaces(v.select(F.col("vec_id").alias("__q"), F.col("vec").alias("__qv"), "role"), v, "role", "namespace").withColumnRenamed("namespace", "key")
    full = candidates(q.select("__q", "__qv", "key"), index, L.RERANK_TOP_K, exclude_self=True).groupBy("__q").agg(F.count("*").alias("full"))
    sizes = index.cells(spark).groupBy("key").agg(F.sum("n").alias("n"))
    readable = q.join(F.broadcast(sizes), "key").groupBy("__q").agg(F.sum("n").alias("readable"))
    return readable.join(full, "__q", "left").select(
        F.col("__q").alias("query_id"), "readable", (F.coalesce("full", F.lit(0)) <= 0.3 * F.col("readable") + L.RERANK_TOP_K).alias("few_read"))


V6_READS_SQL = _pairs_sql() + """
SELECT query_id, CAST(sum(n) AS BIGINT) AS readable, true AS few_read
FROM qn JOIN (SELECT namespace, count(*) AS n FROM vectors GROUP BY namespace) USING (namespace) GROUP BY query_id"""


# -- V7 ----------------------------------------------------------------------
def v7_hypothesis(spark, sf):
    conv = table(spark, sf, "conversations")
    q = chat_queries(conv).withColumn("query_id", pair_id("conv_id", "turn"))
    # generated passages: the assistant reply; those to a conversation's first turn stand for blank generations
    h = chat_answers(conv).select(pair_id("conv_id", "turn").alias("query_id"),
                                  F.when(F.col("turn") > 0, F.col("answer")).otherwise(F.lit("  ")).alias("text"))
    r = R.hypothesis(q, h, "query_id", "query", "text")
    return r.select("query_id", "hyde_used", F.sha2("retrieval_text", 256).alias("retrieval_sha256"),
                    F.length("hyde_prompt").alias("prompt_len"))


def _v7_sql():
    head, tail = L.HYPOTHESIS_PROMPT.split("{query}")
    return with_sql("chat_queries", "chat_answers") + f"""
, h AS (SELECT {sql_pair_id('conv_id', 'turn')} AS query_id,
               {D.strip("CASE WHEN turn > 0 THEN answer ELSE '  ' END")} AS hyp FROM chat_answers),
j AS (SELECT {sql_pair_id('q.conv_id', 'q.turn')} AS query_id, q.query,
             coalesce(nullif(h.hyp, ''), q.query) AS rt FROM chat_queries q LEFT JOIN h ON h.query_id = {sql_pair_id('q.conv_id', 'q.turn')})
SELECT query_id, rt <> query AS hyde_used, sha256(rt) AS retrieval_sha256,
       CAST(length({D.q(head)} || query || {D.q(tail)}) AS INTEGER) AS prompt_len FROM j"""


# -- V8/V9 ---------------------------------------------------------------------
def _second_scorer(spark, sf, cand):
    """The default pair scorer, E1, on whole texts: those of the documents with the query's and the chunk's id.

    Only documents that are a candidate's side are tokenised, each once, and their tokens travel as hashes.
    """
    sides = cand.select(F.col("query_id").alias("doc_id")).union(cand.select(F.col("chunk_id").alias("doc_id"))).distinct()
    d = materialize(table(spark, sf, "documents").join(sides, "doc_id", "left_semi").select("doc_id", hashed_token_set("text").alias("s")))
    qs = d.select(F.col("doc_id").alias("query_id"), F.col("s").alias("qs"))
    cs = d.select(F.col("doc_id").alias("chunk_id"), F.col("s").alias("cs"))
    return cand.join(qs, "query_id", "left").join(cs, "chunk_id", "left").withColumn(
        "score", F.round(f1_of_sets(F.col("qs"), F.col("cs")), 6)).drop("qs", "cs")


def _reranked(spark, sf, keep_scores=False):
    cand = materialize(_retrieve(spark, sf, L.RERANK_CANDIDATES).drop("score"))
    return R.rerank(_second_scorer(spark, sf, cand), L.RERANK_TOP_K, keep_scores=keep_scores)


def v8_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "chunk_id", "retrieval_rank", "rank", "rerank_used")


def _rerank_sql():
    inter = "len(list_intersect(qd.s, cd.s))"
    f1 = (f"CASE WHEN len(qd.s) = 0 OR len(cd.s) = 0 THEN 0.0::DOUBLE WHEN {inter} = 0 THEN 0.0::DOUBLE ELSE "
          f"2 * ({inter} / len(qd.s)) * ({inter} / len(cd.s)) / (({inter} / len(qd.s)) + ({inter} / len(cd.s))) END")
    return _pairs_sql() + f""",
ds AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM documents),
cand AS (SELECT query_id, chunk_id, CAST(retrieval_rank AS INTEGER) AS retrieval_rank FROM rk WHERE retrieval_rank <= 8),
s AS (SELECT cand.*, round({f1}, 6) AS score, count(*) OVER (PARTITION BY cand.query_id) > 4 AS rerank_used
      FROM cand LEFT JOIN ds qd ON qd.doc_id = cand.query_id LEFT JOIN ds cd ON cd.doc_id = cand.chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_used THEN score END DESC NULLS LAST,
              retrieval_rank) AS INTEGER) AS rank FROM s)"""


V8_SQL = _rerank_sql() + "\nSELECT query_id, chunk_id, retrieval_rank, rank, rerank_used FROM r WHERE rank <= 4"


def v9_rerank_scores(spark, sf):
    return _reranked(spark, sf, True).select("query_id", "chunk_id", "rank", "rerank_score")


V9_SQL = _rerank_sql() + "\nSELECT query_id, chunk_id, rank, coalesce(score, 0.0) AS rerank_score FROM r WHERE rank <= 4"


# -- V10-V12 -------------------------------------------------------------------
def _assembled(spark, sf):
    ranked = _reranked(spark, sf).join(_chunk_text(spark, sf), "chunk_id", "left")
    return R.assemble(ranked)


def v10_context(spark, sf):
    a = _assembled(spark, sf)
    return a.select("query_id", F.sha2("context", 256).alias("context_sha256"), F.length("context").alias("context_len"))


CTX_SQL = _rerank_sql() + f""",
t AS (SELECT r.query_id, r.rank, r.chunk_id, d.text, d.source FROM r
      LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 4),
a AS (SELECT query_id, string_agg(text, {D.q(L.CONTEXT_SEPARATOR)} ORDER BY rank) AS context,
             string_agg(coalesce(source, 'unknown'), ',' ORDER BY rank) AS sources,
             string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids,
             list_sort(list_distinct(list(coalesce(source, 'unknown')))) AS ds
      FROM t GROUP BY query_id)"""
V10_SQL = CTX_SQL + "\nSELECT query_id, sha256(context) AS context_sha256, CAST(length(context) AS INTEGER) AS context_len FROM a"


def v11_prompt(spark, sf):
    a = _assembled(spark, sf).join(_vec(spark, sf).select(F.col("vec_id").alias("query_id"), "role"), "query_id")
    a = a.withColumn("safe_query", F.concat(F.lit("vector query "), F.col("query_id").cast("string")))
    p = R.build_prompt(a)
    return p.select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def _v11_sql():
    t = L.ANSWER_PROMPT.replace("{assistant}", L.DEFAULT_ASSISTANT).replace("{company}", L.DEFAULT_COMPANY)
    a, rest = t.split("{role}")
    b, rest = rest.split("{context}")
    c, d = rest.split("{query}")
    return CTX_SQL + f"""
SELECT a.query_id, sha256({D.q(a)} || v.role || {D.q(b)} || a.context || {D.q(c)} || 'vector query ' ||
  CAST(a.query_id AS VARCHAR) || {D.q(d)}) AS prompt_sha256 FROM a JOIN vectors v ON v.vec_id = a.query_id"""


def v12_sources(spark, sf):
    a = _assembled(spark, sf)
    return a.select("query_id", F.array_join("sources", ",").alias("sources"),
                    F.array_join("chunk_ids", ",").alias("chunk_ids"),
                    F.array_join(F.array_sort("display_sources"), ",").alias("display_sources"))


V12_SQL = CTX_SQL + "\nSELECT query_id, sources, chunk_ids, array_to_string(ds, ',') AS display_sources FROM a"


def closed(namespace: str):
    return F.when(F.col(namespace) == "general", F.lit("legal")).otherwise(F.col(namespace))


def v13_no_documents(spark, sf):
    v = _vec(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), "role", "vec")
    # what every role may read is filed under a namespace that none lists: roles with no other have nothing
    c = v.select(F.col("vec_id").alias("chunk_id"), closed("namespace").alias("namespace"), "vec")
    got = R.retrieve(q, c, 1, exclude_self=True)
    return R.no_documents(q, got).select("query_id", "response")


V13_SQL = _pairs_sql() + f"""
SELECT q.vec_id AS query_id, {D.q(L.MSG_NO_DOCUMENTS)} AS response FROM vectors q
WHERE q.vec_id NOT IN (SELECT query_id FROM rk JOIN vectors c ON c.vec_id = rk.chunk_id
  JOIN vectors a ON a.vec_id = rk.query_id WHERE c.namespace <> 'general' OR {D.norm_role('a.role')} = 'c-levelexecutives')"""


# -- cache -------------------------------------------------------------------
def _cache_sides(spark, sf, read=_vec):
    v = read(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), "vec", F.col("created_at").alias("ts"), "role")
    e = read(spark, sf).select(F.col("vec_id").alias("entry_id"), "vec", "created_at", "owner_role")
    return q, e


def c1_cache_lookup(spark, sf):
    q, e = _cache_sides(spark, sf)
    return C.lookup(q, e, threshold=THRESHOLD)


def _level_sql(col):
    return "CASE " + " ".join(f"WHEN {D.norm_role(col)} = {D.q(r)} THEN {lvl}" for r, lvl in L.ROLE_LEVELS) + " ELSE 0 END"


CACHE_SQL = with_sql("vectors") + f"""
, p AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round({_cos_sql('q.vec', 'e.vec')}, 6) AS sim, e.created_at
  FROM vectors q JOIN vectors e ON e.created_at < q.created_at AND q.created_at - e.created_at < INTERVAL {TTL} SECOND),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, created_at, entry_id) AS rn
  FROM p WHERE sim > 0) WHERE rn = 1),
lk AS (SELECT q.vec_id AS query_id, b.entry_id, b.sim,
  coalesce(b.sim >= {THRESHOLD} AND {_level_sql('q.role')} >= {_level_sql('e.owner_role')}, false) AS hit
  FROM vectors q LEFT JOIN b ON b.query_id = q.vec_id LEFT JOIN vectors e ON e.vec_id = b.entry_id)"""
C1_SQL = CACHE_SQL + "\nSELECT query_id, entry_id, sim, hit FROM lk"


def c2_live_entries(spark, sf):
    _, e = _cache_sides(spark, sf)
    as_of = e.select(F.max("created_at")).scalar()
    return C.live_entries(e, as_of).select("entry_id")


C2_SQL = with_sql("vectors") + f"""SELECT vec_id AS entry_id FROM vectors
WHERE (SELECT max(created_at) FROM vectors) - created_at < INTERVAL {TTL} SECOND"""


def c3_capacity(spark, sf):
    _, e = _cache_sides(spark, sf)
    return C.enforce_capacity(e, 40, shard="owner_role").select("entry_id", "owner_role")


C3_SQL = with_sql("vectors") + """SELECT entry_id, owner_role FROM (
  SELECT vec_id AS entry_id, owner_role, row_number() OVER (PARTITION BY owner_role ORDER BY created_at DESC, vec_id DESC) AS rn
  FROM vectors) WHERE rn <= 40"""


def c4_stats(spark, sf):
    q, e = _cache_sides(spark, sf)
    lk = C.lookup(q, e, threshold=THRESHOLD)
    e = e.withColumn("hits", F.lit(0))
    live = C.live_entries(C.apply_hits(e, lk), e.select(F.max("created_at")).scalar())
    return C.stats(live, threshold=THRESHOLD)


C4_SQL = CACHE_SQL + f"""
, h AS (SELECT entry_id, count(*) AS n FROM lk WHERE hit GROUP BY entry_id),
live AS (SELECT v.vec_id, coalesce(h.n, 0) AS hits FROM vectors v LEFT JOIN h ON h.entry_id = v.vec_id
  WHERE (SELECT max(created_at) FROM vectors) - v.created_at < INTERVAL {TTL} SECOND)
SELECT count(*) AS entries, CAST(coalesce(sum(hits), 0) AS BIGINT) AS total_hits, {TTL} AS ttl_seconds,
  {THRESHOLD}::DOUBLE AS threshold FROM live"""


def c7_near_duplicates(spark, sf):
    q, _ = _cache_sides(spark, sf)
    return C.near_duplicates(q, threshold=THRESHOLD)


C7_SQL = with_sql("vectors") + f"""
, d AS (SELECT DISTINCT q.vec_id FROM vectors q JOIN vectors e ON e.created_at < q.created_at
  AND q.created_at - e.created_at < INTERVAL {TTL} SECOND WHERE round({_cos_sql('q.vec', 'e.vec')}, 6) >= {THRESHOLD})
SELECT count(*) AS queries, CAST(count(d.vec_id) AS BIGINT) AS near_duplicates,
  round(count(d.vec_id) / count(*), 6) AS share FROM vectors v LEFT JOIN d ON d.vec_id = v.vec_id"""


QUERIES = {
    "v1_chunks": v1_chunks,
    "v4_cosine": v4_cosine,
    "v5_topk": v5_topk,
    "v3_embed": v3_embed,
    "v6_approx_topk": v6_approx_topk,
    "v6_index_reads": v6_index_reads,
    "v7_hypothesis": v7_hypothesis,
    "v8_rerank": v8_rerank,
    "v9_rerank_scores": v9_rerank_scores,
    "v10_context": v10_context,
    "v11_prompt": v11_prompt,
    "v12_sources": v12_sources,
    "v13_no_documents": v13_no_documents,
    "c1_cache_lookup": c1_cache_lookup,
    "c2_live_entries": c2_live_entries,
    "c3_capacity": c3_capacity,
    "c4_stats": c4_stats,
    "c7_near_duplicates": c7_near_duplicates,
}
ORACLE = {
    "v1_chunks": V1_SQL,
    "v4_cosine": V4_SQL,
    "v5_topk": _v5_sql(L.RERANK_TOP_K),
    "v3_embed": V3_SQL,
    "v6_approx_topk": _v5_sql(L.RERANK_TOP_K),
    "v6_index_reads": V6_READS_SQL,
    "v7_hypothesis": _v7_sql(),
    "v8_rerank": V8_SQL,
    "v9_rerank_scores": V9_SQL,
    "v10_context": V10_SQL,
    "v11_prompt": _v11_sql(),
    "v12_sources": V12_SQL,
    "v13_no_documents": V13_SQL,
    "c1_cache_lookup": C1_SQL,
    "c2_live_entries": C2_SQL,
    "c3_capacity": C3_SQL,
    "c4_stats": C4_SQL,
    "c7_near_duplicates": C7_SQL,
}


def v1_boundary_chunks(spark, sf):
    """Windows that end at the best break in reach, of every document, whole."""
    from ..operators.ingest import boundary_chunks
    ch = boundary_chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return ch.select("doc_id", "pos", "chunk_id", F.length("chunk_text").alias("chunk_len"), F.sha2("chunk_text", 256).alias("chunk_sha256"))


def _v1_boundary_sql(size=L.CHUNK_SIZE, overlap=L.CHUNK_OVERLAP):
    from ..operators.ingest import BREAKS
    tail = f"substr(text, lo + {overlap + 1}, {size - overlap})"
    code = lambda m: " || ".join(f"chr({ord(c)})" for c in m)
    pattern = lambda m: "'(?s)^(.*)' || " + " || ".join(f"'\\' || chr({ord(c)})" if c == "." else f"chr({ord(c)})" for c in m)
    hi = f"CASE WHEN lo + {size} >= n THEN n " + " ".join(
        f"WHEN contains({tail}, {code(m)}) THEN lo + {overlap} + length(regexp_extract({tail}, {pattern(m)}, 1)) + {len(m)}" for m in BREAKS) + f" ELSE lo + {size} END"
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, text, n, lo, {hi} AS hi, 0 AS step FROM (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS lo FROM documents WHERE length(text) > 0)
  UNION ALL
  SELECT doc_id, text, n, lo, {hi} AS hi, step + 1 FROM (
    SELECT doc_id, text, n, hi - {overlap} + strpos(substr(text, hi - {overlap} + 1, {overlap - 1}), ' ') AS lo, step FROM w WHERE hi < n)),
p AS (SELECT doc_id, step, {D.strip('substr(text, lo + 1, hi - lo)')} AS piece FROM w),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS pos, piece FROM p WHERE piece <> '')
SELECT doc_id, pos, sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS chunk_id, CAST(length(piece) AS INTEGER) AS chunk_len,
  sha256(piece) AS chunk_sha256 FROM c"""


QUERIES["v1_boundary_chunks"] = v1_boundary_chunks
ORACLE["v1_boundary_chunks"] = _v1_boundary_sql()


def c5_invalidate(spark, sf):
    """A re-ingest at the midpoint of the cache's time span bumps the index version;
    entries written before it carry the old version and are dropped."""
    _, e = _cache_sides(spark, sf)
    span = e.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    mid = span.select(F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", "lo", "hi") / 2), F.col("lo"))
                      ).scalar()
    versioned = e.withColumn("index_version", F.when(F.col("created_at") < mid, F.lit(1)).otherwise(F.lit(2)))
    return C.invalidate(versioned, 2).select("entry_id", "index_version")


C5_SQL = with_sql("vectors") + """
, m AS (SELECT min(created_at) + to_seconds(floor(date_diff('second', min(created_at), max(created_at)) / 2)::BIGINT) AS mid
  FROM vectors)
SELECT vec_id AS entry_id, 2 AS index_version FROM vectors, m WHERE created_at >= m.mid"""

QUERIES["c5_invalidate"] = c5_invalidate
ORACLE["c5_invalidate"] = C5_SQL


def c1_stream_candidates(spark, sf):
    """C1 with both sides as streams: each query's best live entry and whether it is a hit."""
    from ..streaming import stateful as ST
    q, e = _cache_sides(spark, sf, lambda spark, sf: vectors(ST.read_stream(spark, f"{sf}/embeddings.parquet")))
    path = scratch(spark, "candidates")
    found = ST.cache_candidates(q, e, ttl_s=TTL, watermark="1 minute")
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "candidates-checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    return ST.best_candidates(spark.read.parquet(path), threshold=THRESHOLD).select("query_id", "entry_id", "sim", "hit")


QUERIES["c1_stream_candidates"] = c1_stream_candidates
ORACLE["c1_stream_candidates"] = f"SELECT * FROM ({C1_SQL}) WHERE entry_id IS NOT NULL"

"""Registered composed pipelines (P1 chat outcomes and sinks) and the S5 upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import libraries as L
from ..plans.chat import chat, sinks
from ..sources.driver_tables import (chat_answers, chat_queries, chunks_from_documents, pair_id, sql_cost, sql_pair_id, table,
                                     vectors, with_sql)
from ..session import scratch
from . import duck as D
from .vectors import closed

BASE = "2024-01-01 00:00:00"


def _requests(spark, sf):
    q = chat_queries(table(spark, sf, "conversations"))
    return q.select(pair_id("conv_id", "turn").alias("query_id"),
                    (F.lit(BASE).cast("timestamp_ntz") + F.make_interval(
                        mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))).alias("ts"),
                    "username", "role", "query", "conv_id")


def _pick_vector(spark, sf, key: str):
    """An embedder that takes vectors from the table: row number ``key`` modulo its length."""
    v = vectors(table(spark, sf, "embeddings"))
    many = v.agg(F.count(F.lit(1))).scalar()

    def embed(df, text: str, out: str = "vec"):
        at = F.expr(key) if isinstance(key, str) else key
        keyed = df.withColumn("__v", F.pmod(at, many))
        return keyed.join(v.select(F.col("vec_id").alias("__v"), F.col("vec").alias(out)), "__v", "left").drop("__v")

    return embed


#: Requests within three minutes share a vector, so that a conversation's next turn can hit the cache.
SLOT = f"timestampdiff(MINUTE, TIMESTAMP_NTZ'{BASE}', ts) div 3"


def _chunks(spark, sf):
    """Every V1 window of every document. What all roles may read is filed under a namespace that no role
    lists, so that some requests find no documents."""
    from ..operators.ingest import fixed_chunks
    d = chunks_from_documents(table(spark, sf, "documents")).withColumn("namespace", closed("namespace"))
    ch = fixed_chunks(d.select("doc_id", "text", "namespace", "source")).select(
        pair_id("doc_id", "pos").alias("chunk_id"), "namespace", F.col("chunk_text").alias("text"), "source")
    return _pick_vector(spark, sf, "chunk_id")(ch, "text", "vec")


def _answers(spark, sf):
    a = chat_answers(table(spark, sf, "conversations"))
    return a.select(pair_id("conv_id", "turn").alias("query_id"), "answer", F.length("answer").cast("double").alias("latency_ms"))


def _cache(spark, sf):
    """Earlier turns' answers as cache entries (owner = asker's role)."""
    req = _pick_vector(spark, sf, SLOT)(_requests(spark, sf), "query", "vec")
    return req.join(_answers(spark, sf), "query_id").select(
        F.col("query_id").alias("entry_id"), "vec", F.col("ts").alias("created_at"),
        F.col("role").alias("owner_role"), F.col("answer").alias("response"),
        F.array(F.lit("cache")).alias("sources"), F.lit(L.MODEL_RATES_E8[0][0]).alias("model_used"))


def _chat(spark, sf):
    return chat(_requests(spark, sf).drop("conv_id"), _chunks(spark, sf), _answers(spark, sf), cache_entries=_cache(spark, sf),
                embed=_pick_vector(spark, sf, SLOT))


def p1_chat_outcomes(spark, sf):
    return _chat(spark, sf).select(
        "query_id", "outcome", "model_used", "complexity", "tokens_used", "cost_usd", "latency_ms", "cache_hit", "guardrail_reason",
        "rerank_used", F.sha2("response", 256).alias("response_sha256"), F.array_join("sources", ",").alias("sources"),
        F.array_join("chunk_ids", ",").alias("chunk_ids"), "entry_id")


def p1_metrics_sink(spark, sf):
    return sinks(_chat(spark, sf))["query_metrics"].drop("ts")


def p1_events_sink(spark, sf):
    return sinks(_chat(spark, sf))["guardrail_events"].drop("ts")


def _pair_scores(pairs: str) -> str:
    """V4 of every distinct pair (v1, v2) of rows of ``vectors``."""
    return f"""SELECT v1, v2, round(CASE WHEN a.dim = 0 OR b.dim = 0 OR a.dim <> b.dim OR a.norm = 0 OR b.norm = 0 THEN 0.0::DOUBLE
    ELSE list_dot_product(a.vec, b.vec) / (a.norm * b.norm) END, 6) AS sim
  FROM (SELECT DISTINCT v1, v2 FROM {pairs}) JOIN vn a ON a.vid = v1 JOIN vn b ON b.vid = v2"""


def _p1_sql() -> str:
    """CTEs up to ``outcomes``: the same request path, step by step."""
    from .evaluation import _f1
    ctes, red = D.pii_redact_ctes("req", "query", "r")
    s = D.scope_cols("query")
    head, tail = L.MSG_INJECTION.split("{attack}")
    phead, ptail = L.MSG_PII.split("{types}")
    shead = L.MSG_SCOPE.split("{reason}")[0].format(assistant=L.DEFAULT_ASSISTANT)
    ttl, threshold = L.CACHE_TTL_SECONDS, L.CACHE_THRESHOLD
    level = lambda c: "CASE " + " ".join(f"WHEN {D.norm_role(c)} = {D.q(r)} THEN {n}" for r, n in L.ROLE_LEVELS) + " ELSE 0 END"
    models = {c: m for pr, c, m, _ in L.ROUTING_DEFAULTS if pr == L.DEFAULT_PROVIDER}
    model = "CASE complexity " + " ".join(f"WHEN {D.q(c)} THEN {D.q(m)}" for c, m in models.items()) + " END"
    t = L.ANSWER_PROMPT.replace("{assistant}", L.DEFAULT_ASSISTANT).replace("{company}", L.DEFAULT_COMPANY)
    pa, rest = t.split("{role}")
    pb, rest = rest.split("{context}")
    pc, pd = rest.split("{query}")
    octes, ored = D.pii_redact_ctes("joined", "answer", "o")
    none = "NULL::BIGINT AS entry_id"
    return with_sql("chat_queries", "chat_answers", "chunks", "vectors") + f"""
, req AS (SELECT {sql_pair_id('conv_id', 'turn')} AS query_id, conv_id, turn, TIMESTAMP '{BASE}' + to_minutes(conv_id * 10 + turn) AS ts,
   username, role, query FROM chat_queries),
ans AS (SELECT {sql_pair_id('conv_id', 'turn')} AS query_id, answer, CAST(length(answer) AS DOUBLE) AS latency_ms FROM chat_answers),
nv AS MATERIALIZED (SELECT count(*) AS n FROM vectors),
vn AS MATERIALIZED (SELECT vec_id AS vid, vec, len(vec) AS dim, sqrt(list_dot_product(vec, vec)) AS norm FROM vectors),
{ctes},
g0 AS (SELECT *, {D.injection_type('query')} AS inj, {D.pii_count('query')} AS npii, {D.pii_detected('query')} AS det,
  {s['in_scope']} AS in_scope, {s['reason']} AS sreason FROM {red}),
g AS MATERIALIZED (SELECT *, CASE WHEN inj <> '' THEN 'INJECTION' WHEN npii > 0 THEN 'PII' WHEN NOT in_scope THEN 'SCOPE' ELSE '' END AS block_type FROM g0),
blocked AS (SELECT *, CASE block_type WHEN 'INJECTION' THEN {D.q(head)} || inj || {D.q(tail)}
  WHEN 'PII' THEN {D.q(phead)} || det || {D.q(ptail)} ELSE {D.q(shead)} || sreason END AS reason FROM g WHERE block_type <> ''),
open AS MATERIALIZED (SELECT g.query_id, g.ts, g.username, g.role, g.query, ((g.conv_id * 10 + g.turn) // 3) % nv.n AS vid FROM g, nv WHERE block_type = ''),
entries AS MATERIALIZED (SELECT req.query_id AS entry_id, req.ts AS created_at, req.role AS owner_role, ((req.conv_id * 10 + req.turn) // 3) % nv.n AS vid,
  ans.answer AS response FROM req JOIN ans USING (query_id), nv),
near_in_time AS MATERIALIZED (SELECT o.query_id, e.entry_id, o.vid AS v1, e.vid AS v2, e.created_at, e.owner_role, o.role, e.response
  FROM open o JOIN entries e ON e.created_at < o.ts AND o.ts - e.created_at < INTERVAL {ttl} SECOND),
probe AS (SELECT t.* EXCLUDE (v1, v2), p.sim FROM near_in_time t JOIN ({_pair_scores('near_in_time')}) p USING (v1, v2)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, created_at, entry_id) AS rn FROM probe WHERE sim > 0) WHERE rn = 1),
hits AS MATERIALIZED (SELECT * FROM best WHERE sim >= {threshold} AND {level('role')} >= {level('owner_role')}),
miss AS MATERIALIZED (SELECT *, {model} AS model FROM (SELECT *, {D.complexity('query', 'role')} AS complexity FROM open
  WHERE query_id NOT IN (SELECT query_id FROM hits))),
win AS (SELECT doc_id, CASE namespace WHEN 'general' THEN 'legal' ELSE namespace END AS namespace, source, text, unnest(generate_series(1, greatest(1, length(text) - 50), 450)) AS start
  FROM chunks WHERE length(text) > 0),
ck0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS pos, namespace, source, substr(text, start, 500) AS text FROM win),
ck AS MATERIALIZED (SELECT {sql_pair_id('doc_id', 'pos')} AS chunk_id, namespace, source, text FROM ck0),
cv AS MATERIALIZED (SELECT chunk_id, namespace, chunk_id % nv.n AS vid FROM ck, nv),
qn AS MATERIALIZED (SELECT m.query_id, m.vid, rn.namespace FROM miss m JOIN {D.role_ns_dim()} ON {D.norm_role('m.role')} = rn.role
    WHERE {D.norm_role('m.role')} <> '{L.UNRESTRICTED_ROLE}'
  UNION ALL SELECT m.query_id, m.vid, 'general' FROM miss m WHERE {D.norm_role('m.role')} NOT IN (SELECT role FROM {D.roles_dim()})
  UNION ALL SELECT m.query_id, m.vid, n.namespace FROM miss m, (SELECT DISTINCT namespace FROM ck) n
    WHERE {D.norm_role('m.role')} = '{L.UNRESTRICTED_ROLE}'),
vid_pairs AS MATERIALIZED (SELECT DISTINCT qn.vid AS v1, c.vid AS v2 FROM (SELECT DISTINCT vid, namespace FROM qn) qn
  JOIN (SELECT DISTINCT vid, namespace FROM cv) c USING (namespace)),
vid_scores AS MATERIALIZED ({_pair_scores('vid_pairs')}),
near AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, rr, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, chunk_id) AS retrieval_rank
  FROM (SELECT qn.query_id, cv.chunk_id, p.sim AS rr FROM qn JOIN cv ON cv.namespace = qn.namespace JOIN vid_scores p ON p.v1 = qn.vid AND p.v2 = cv.vid))
  WHERE retrieval_rank <= {L.RERANK_CANDIDATES}),
scored AS (SELECT near.*, ck.text, ck.source, {_f1('m.query', 'ck.text')} AS score, count(*) OVER (PARTITION BY near.query_id) > {L.RERANK_TOP_K} AS rerank_used
  FROM near JOIN miss m USING (query_id) JOIN ck USING (chunk_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_used THEN score END DESC NULLS LAST, retrieval_rank) AS rank
  FROM scored) WHERE rank <= {L.RERANK_TOP_K}),
ctx AS (SELECT query_id, string_agg(text, {D.q(L.CONTEXT_SEPARATOR)} ORDER BY rank) AS context, string_agg(coalesce(source, 'unknown'), ',' ORDER BY rank) AS sources,
  string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids, bool_or(rerank_used) AS rerank_used FROM ranked GROUP BY query_id),
joined AS MATERIALIZED (SELECT m.query_id, m.username, m.role, m.query, m.complexity, m.model, ctx.* EXCLUDE (query_id), ans.answer, ans.latency_ms,
  {D.q(pa)} || m.role || {D.q(pb)} || ctx.context || {D.q(pc)} || m.query || {D.q(pd)} AS prompt
  FROM miss m JOIN ctx USING (query_id) LEFT JOIN ans USING (query_id)),
{octes},
fin AS MATERIALIZED (SELECT *, {D.tokens("(prompt || answer)")} AS tokens, {D.pii_count('answer')} AS onpii FROM {ored}),
outcomes AS (
SELECT query_id, username, role, query, 'blocked' AS outcome, 'none' AS model_used, 'blocked' AS complexity, 0 AS tokens_used, 0.0::DOUBLE AS cost_usd, 0.0::DOUBLE AS latency_ms,
  false AS cache_hit, reason AS guardrail_reason, block_type, false AS rerank_used, 'Warning: ' || reason AS response, '' AS sources, '' AS chunk_ids, {none} FROM blocked
UNION ALL SELECT h.query_id, o.username, o.role, o.query, 'cached', {D.q(L.MODEL_RATES_E8[0][0])}, 'cached', 0, 0.0, 0.0, true, '', '', false, h.response, 'cache', '', h.entry_id
  FROM hits h JOIN open o USING (query_id)
UNION ALL SELECT query_id, username, role, query, 'no_documents', model, complexity, 0, 0.0, 0.0, false, '', '', false, {D.q(L.MSG_NO_DOCUMENTS)}, '', '', NULL
  FROM miss WHERE query_id NOT IN (SELECT query_id FROM near)
UNION ALL SELECT query_id, username, role, query, 'failed', model, complexity, 0, 0.0, 0.0, false, '', '', rerank_used, '', sources, chunk_ids, NULL FROM fin WHERE answer IS NULL
UNION ALL SELECT query_id, username, role, query, 'completed', model, complexity, tokens, {sql_cost('tokens', 'model')}, latency_ms, false, '', CASE WHEN onpii > 0 THEN 'OUTPUT_PII' ELSE '' END,
  rerank_used, CASE WHEN onpii > 0 THEN o_red ELSE answer END, sources, chunk_ids, NULL FROM fin WHERE answer IS NOT NULL)
"""


QUERIES = {
    "p1_chat_outcomes": p1_chat_outcomes,
    "p1_metrics_sink": p1_metrics_sink,
    "p1_events_sink": p1_events_sink,
}
ORACLE: dict[str, str] = {
    "p1_chat_outcomes": _p1_sql() + """SELECT query_id, outcome, model_used, complexity, tokens_used, cost_usd, latency_ms, cache_hit, guardrail_reason,
  rerank_used, sha256(response) AS response_sha256, sources, chunk_ids, entry_id FROM outcomes""",
    "p1_metrics_sink": _p1_sql() + """SELECT query_id AS id, username, role, model_used, complexity, latency_ms, tokens_used, cost_usd, cache_hit,
  outcome = 'blocked' AS guardrail_triggered, guardrail_reason FROM outcomes WHERE outcome IN ('blocked', 'cached', 'completed')""",
    "p1_events_sink": _p1_sql() + """SELECT username, role, block_type AS event_type, guardrail_reason AS reason, left(sha256(query), 16) AS query_hash
  FROM outcomes WHERE outcome = 'blocked'""",
}


# -- S4/S5: tagging and chunk-metadata upsert over documents -------------------------
def _meta(spark, sf, ts):
    from ..operators.ingest import fixed_chunks
    d = chunks_from_documents(table(spark, sf, "documents")).select("doc_id", "text", "file_name", "namespace")
    ch = fixed_chunks(d)
    return ch.select("chunk_id", "file_name", F.col("namespace").alias("role"), F.col("namespace").alias("department"),
                     F.col("file_name").alias("source"), F.lit(ts).cast("timestamp_ntz").alias("indexed_at"), "doc_id")


def s5_doc_chunks_upsert(spark, sf):
    """A first ingest of every document, then a re-ingest of the labelled ones: last write wins."""
    from ..sources.sinks import upsert_latest
    first = _meta(spark, sf, "2024-01-01 00:00:00")
    again = _meta(spark, sf, "2024-01-02 00:00:00").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    out = upsert_latest(first, again)
    return out.select("chunk_id", "file_name", "department", F.date_format("indexed_at", "yyyy-MM-dd").alias("day"))


def _s5_sql():
    from ..sources.driver_tables import with_sql
    return with_sql("chunks") + """
, s AS (SELECT doc_id, file_name, unnest(generate_series(1, greatest(1, length(text) - 50), 450)) AS start
  FROM chunks WHERE length(text) > 0),
c AS (SELECT doc_id, file_name, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS pos FROM s),
m AS (SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS chunk_id, file_name, doc_id FROM c)
SELECT m.chunk_id, m.file_name, ch.namespace AS department,
  CASE WHEN m.doc_id IN (SELECT doc_id FROM labels) THEN '2024-01-02' ELSE '2024-01-01' END AS day
FROM m JOIN chunks ch USING (doc_id)"""


QUERIES["s5_doc_chunks_upsert"] = s5_doc_chunks_upsert
ORACLE["s5_doc_chunks_upsert"] = _s5_sql()


def s5_bucketed_merge(spark, sf):
    """The same two ingests as merges into a stored table of hash buckets."""
    from ..sources.sinks import merge_latest
    path = scratch(spark, "doc-chunks")
    merge_latest(spark, _meta(spark, sf, "2024-01-01 00:00:00"), path)
    merge_latest(spark, _meta(spark, sf, "2024-01-02 00:00:00").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), path)
    return spark.read.parquet(path).select("chunk_id", "file_name", "department", F.date_format("indexed_at", "yyyy-MM-dd").alias("day"))


QUERIES["s5_bucketed_merge"] = s5_bucketed_merge
ORACLE["s5_bucketed_merge"] = _s5_sql()


# -- S6 and C5: index and metadata published together ---------------------------------
def s6_published_index(spark, sf):
    """All documents are published, then the labelled ones again as the next version: readers see one version of both tables.

    Chunks per department of the current version with the rows of its metadata, and the version C5 keeps.
    """
    from ..operators.cache import invalidate
    from ..sources import versions
    from ..sources.sinks import publish_index
    root = scratch(spark, "published")
    meta = _meta(spark, sf, "2024-01-01 00:00:00")
    version = 0
    for wanted in (meta, meta.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")):
        version = publish_index(wanted.select("chunk_id", "department", "doc_id"), wanted.drop("department"), root)
    chunks, rows = (versions.read(spark, root, t, version) for t in ("chunks", "doc_chunks"))
    entries = chunks.join(rows, "chunk_id").withColumn("index_version", F.lit(version))
    return invalidate(entries, versions.current_version(spark, root)).groupBy("department", "index_version").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_name").alias("files"))


QUERIES["s6_published_index"] = s6_published_index
ORACLE["s6_published_index"] = _s5_sql().replace("SELECT m.chunk_id, m.file_name", "SELECT department, 2 AS index_version, count(*) AS chunks, count(DISTINCT file_name) AS files FROM (SELECT m.chunk_id, m.file_name") + """
WHERE m.doc_id IN (SELECT doc_id FROM labels)) GROUP BY department"""


# -- S3: all documents as CSV files, cut by Spark, with line breaks inside quotes ---------
def s3_csv_split(spark, sf):
    from ..sources.files import split_csv_documents
    path = scratch(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text").write.option("header", True).option("escape", '"').csv(path)
    rows = split_csv_documents(spark, path)
    return rows.select(F.sha2("text", 256).alias("row_sha256"), F.length("text").alias("row_len"), F.coalesce("error", F.lit("")).alias("error"))


QUERIES["s3_csv_split"] = s3_csv_split
ORACLE["s3_csv_split"] = f"""SELECT sha256(r) AS row_sha256, CAST(length(r) AS INTEGER) AS row_len, '' AS error
FROM (SELECT 'doc_id: ' || doc_id || chr(10) || 'text: ' || {D.strip("coalesce(text, '')")} AS r FROM documents)"""

"""Registered access-control (R1-R5) and routing/cost (T1-T4) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.routing import complexity, estimate_tokens
from ..functions.text import norm_role, word_count
from ..operators import access as A
from ..operators.routing import route
from ..sources.driver_tables import (USER_ROLES, chat_queries, chunks_from_documents, pick, query_metrics,
                                     table, vectors, with_sql)
from . import duck as D


def _users(spark, sf):
    return chat_queries(table(spark, sf, "conversations"))


def r1_allowed_namespaces(spark, sf):
    u = _users(spark, sf)
    return u.select("conv_id", "turn", norm_role("role").alias("role_norm"),
                    F.array_join(A.allowed_namespaces("role"), ",").alias("namespaces"))


def _r1_sql():
    ns = "CASE " + " ".join(
        f"WHEN {D.norm_role('role')} = {D.q(r)} THEN {D.q(','.join(n))}" for r, n in A.L.ROLE_NAMESPACES
    ) + " ELSE 'general' END"
    return with_sql("chat_queries") + f"SELECT conv_id, turn, {D.norm_role('role')} AS role_norm, {ns} AS namespaces FROM chat_queries"


def r2_visible_chunks(spark, sf):
    chunks = chunks_from_documents(table(spark, sf, "documents")).select("doc_id", "namespace")
    principals = _users(spark, sf).select(A.role_class("role").alias("role")).distinct()
    return A.visible_rows(principals, chunks, "role", bounded=True).select("role", "doc_id", "namespace")


def _r2_sql():
    return with_sql("chat_queries", "chunks") + f"""
, p AS (SELECT DISTINCT CASE WHEN {D.norm_role('role')} IN (SELECT role FROM {D.roles_dim()}) THEN {D.norm_role('role')}
                        ELSE 'unknown' END AS role FROM chat_queries),
pairs AS (
  SELECT p.role, rn.namespace FROM p JOIN {D.role_ns_dim()} ON p.role = rn.role WHERE p.role <> 'c-levelexecutives'
  UNION ALL SELECT p.role, 'general' FROM p WHERE p.role NOT IN (SELECT role FROM {D.roles_dim()})
  UNION ALL SELECT p.role, c.namespace FROM p, (SELECT DISTINCT namespace FROM chunks) c WHERE p.role = 'c-levelexecutives')
SELECT pairs.role, chunks.doc_id, chunks.namespace FROM pairs JOIN chunks ON pairs.namespace = chunks.namespace"""


def r3_role_level(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", "role", A.role_level("role").alias("level"))


def _level_sql(col):
    return "CASE " + " ".join(f"WHEN {D.norm_role(col)} = {D.q(r)} THEN {lvl}" for r, lvl in A.L.ROLE_LEVELS) + " ELSE 0 END"


def _r3_sql():
    return with_sql("chat_queries") + f"SELECT conv_id, turn, role, {_level_sql('role')} AS level FROM chat_queries"


def r4_can_access(spark, sf):
    v = vectors(table(spark, sf, "embeddings"))
    return v.select("vec_id", "role", "owner_role", A.can_access("role", "owner_role").alias("can_access"))


def _r4_sql():
    return with_sql("vectors") + (f"SELECT vec_id, role, owner_role, {_level_sql('role')} >= {_level_sql('owner_role')} "
                                  f"AS can_access FROM vectors")


def r4_accessible_counts(spark, sf):
    v = vectors(table(spark, sf, "embeddings"))
    roles = spark.createDataFrame([(r,) for r in USER_ROLES], "role string")
    return A.accessible_counts(roles, v, "role", "owner_role")


def _r4c_sql():
    roles = D.values([(r,) for r in USER_ROLES], ["role"])
    return with_sql("vectors") + f"""SELECT v.role, CAST(count(x.vec_id) AS BIGINT) AS accessible
FROM {roles} LEFT JOIN vectors x ON {_level_sql('v.role')} >= {_level_sql('x.owner_role')} GROUP BY v.role"""


def r5_invalid_roles(spark, sf):
    u = _users(spark, sf)
    return A.invalid_roles(u, "role").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _r5_sql():
    valid = ", ".join(D.q(r) for r, _ in A.L.ROLE_LEVELS)
    return with_sql("chat_queries") + (f"SELECT role, count(*) AS n FROM chat_queries WHERE {D.norm_role('role')} "
                                       f"NOT IN ({valid}) GROUP BY role")


# -- routing -------------------------------------------------------------------
def t1_complexity(spark, sf):
    u = _users(spark, sf)
    return u.select("conv_id", "turn", complexity("query", "role").alias("complexity"),
                    word_count("query").alias("n_words"))


def _t1_sql():
    return with_sql("chat_queries") + (f"SELECT conv_id, turn, {D.complexity('query', 'role')} AS complexity, "
                                       f"CAST({D.words('query')} AS INTEGER) AS n_words FROM chat_queries")


OVERRIDES = {"moderate": "custom-balanced-model", "simple": "   "}


def t2_route(spark, sf):
    u = _users(spark, sf).withColumn("provider", pick(["groq", "ollama"], F.col("conv_id")))
    r = route(u, "query", "role", provider="provider", overrides=OVERRIDES)
    return r.select("conv_id", "turn", "provider", "complexity", "model_name", "rationale", "router_rate")


def _t2_sql():
    from ..functions import libraries as L
    labels = dict(L.PROVIDER_LABELS)
    why = dict(L.RATIONALES)
    rows = [(p, c, OVERRIDES.get(c, "").strip() or m, why[c].format(label=labels[p]), float(r))
            for p, c, m, r in L.ROUTING_DEFAULTS]
    dim = D.values(rows, ["provider", "complexity", "model_name", "rationale", "router_rate"])
    return with_sql("chat_queries") + f""", u AS (
  SELECT conv_id, turn, ['groq', 'ollama'][((conv_id % 2) + 2) % 2 + 1] AS provider,
         {D.complexity('query', 'role')} AS complexity FROM chat_queries)
SELECT u.conv_id, u.turn, u.provider, u.complexity, v.model_name, v.rationale, CAST(v.router_rate AS DOUBLE) AS router_rate
FROM u LEFT JOIN {dim} ON u.provider = v.provider AND u.complexity = v.complexity"""


def t3_tokens(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", estimate_tokens("text").alias("tokens"))


def _t3_sql():
    return f"SELECT conv_id, turn, {D.tokens('text')} AS tokens FROM conversations"


def t4_cost(spark, sf):
    m = query_metrics(table(spark, sf, "events"))
    return m.select("id", "model_used", "tokens_used", "cost_usd")


def _t4_sql():
    return with_sql("query_metrics") + "SELECT id, model_used, tokens_used, cost_usd FROM query_metrics"


QUERIES = {
    "r1_allowed_namespaces": r1_allowed_namespaces,
    "r2_visible_chunks": r2_visible_chunks,
    "r3_role_level": r3_role_level,
    "r4_can_access": r4_can_access,
    "r4_accessible_counts": r4_accessible_counts,
    "r5_invalid_roles": r5_invalid_roles,
    "t1_complexity": t1_complexity,
    "t2_route": t2_route,
    "t3_tokens": t3_tokens,
    "t4_cost": t4_cost,
}
ORACLE = {
    "r1_allowed_namespaces": _r1_sql(),
    "r2_visible_chunks": _r2_sql(),
    "r3_role_level": _r3_sql(),
    "r4_can_access": _r4_sql(),
    "r4_accessible_counts": _r4c_sql(),
    "r5_invalid_roles": _r5_sql(),
    "t1_complexity": _t1_sql(),
    "t2_route": _t2_sql(),
    "t3_tokens": _t3_sql(),
    "t4_cost": _t4_sql(),
}


def r2_single_role_filter(spark, sf):
    """R2 for one fixed role: an ``isin`` on namespace (prunes department partitions when stored so)."""
    chunks = chunks_from_documents(table(spark, sf, "documents")).select("doc_id", "namespace")
    return A.namespace_filter(chunks, " Finance ").select("doc_id", "namespace")


QUERIES["r2_single_role_filter"] = r2_single_role_filter
ORACLE["r2_single_role_filter"] = with_sql("chunks") + \
    "SELECT doc_id, namespace FROM chunks WHERE namespace IN ('finance', 'general')"

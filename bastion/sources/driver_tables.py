"""Stand-ins for the service's tables, derived from the driver's parquet tables.

The service keeps chats, metrics, feedback, chunks and cache entries; the test data
has documents, conversations, events and embeddings. Each function below is a
narrow projection (no shuffle) that gives a driver table the shape of a domain
DuckDB CTEs for the oracle queries; both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.routing import cost_usd

# Namespaces a document can fall in: the six permission namespaces plus one that no
# role lists, so that only the unrestricted role can see it.
NAMESPACES = ["finance", "hr", "engineering", "marketing", "general", "c-levelexecutives", "legal"]
# User roles: the six known roles plus 'general', which is not a role (unknown-role case).
USER_ROLES = ["c-levelexecutives", "finance", "hr", "engineering", "marketing", "employee", "general"]
OWNER_ROLES = [r for r, _ in L.ROLE_LEVELS]
MODELS = [m for m, _ in L.MODEL_RATES_E8][:3]
COMPLEXITIES = ["simple", "moderate", "complex"]
CACHE_BASE = "2024-01-01 00:00:00"
CACHE_SPACING_S = 60


def pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` for a non-negative integer column (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(idx, F.lit(len(values))).cast("int") + 1)


TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}
#: Session setting of bench and test runs: deal a text table's rows over so many partitions. A file
#: of one row group scans as one task, however costly the regexes on it are. Unset (the default, and
#: right for tables of many files) the scan is taken as it is.
DEAL_KEY = "spark.bastion.dealTextTables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(DEAL_KEY, None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df


def pair_id(a: str, b: str) -> Column:
    """One number for a pair of non-negative integers, never the same for two pairs (Cantor pairing).

    Overflow (a + b beyond 4e9) fails under ANSI mode rather than colliding.
    """
    s = F.col(a).cast("long") + F.col(b).cast("long")
    return F.shiftright(s * (s + 1), 1) + F.col(b).cast("long")


def sql_pair_id(a: str, b: str) -> str:
    return f"((({a}) + ({b})) * (({a}) + ({b}) + 1) // 2 + ({b}))"


def doc_namespace(source: Column) -> Column:
    return pick(NAMESPACES, F.substring(source, 4, 10).cast("int"))


def chunks_from_documents(documents: DataFrame) -> DataFrame:
    """documents -> (doc_id, text, source, file_name, namespace, n_chars)."""
    return documents.select(
        "doc_id", "text", "source",
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        doc_namespace(F.col("source")).alias("namespace"),
        "n_chars",
    )


def user_role(conv_id: Column) -> Column:
    """Raw role as a client sends it: mixed case and padding for odd ids, to exercise normalisation."""
    r = pick(USER_ROLES, conv_id)
    return F.when(F.pmod(conv_id, F.lit(2)) == 1, F.concat(F.lit(" "), F.upper(r), F.lit(" "))).otherwise(r)


def chat_queries(conversations: DataFrame) -> DataFrame:
    """User turns as chat requests: (conv_id, turn, username, role, query)."""
    return conversations.where(F.col("role") == "user").select(
        "conv_id", "turn",
        F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("username"),
        user_role(F.col("conv_id")).alias("role"),
        F.col("text").alias("query"),
    )


def chat_answers(conversations: DataFrame) -> DataFrame:
    """Assistant turns keyed to the user turn they answer: (conv_id, turn, answer)."""
    return conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))


def query_metrics(events: DataFrame) -> DataFrame:
    """events -> query_metrics rows (schema of the service's metrics table)."""
    blocked = F.col("event_type") == "error"
    cached = F.col("event_type") == "view"
    model = F.when(blocked, F.lit("none")).otherwise(pick(MODELS, F.col("event_id")))
    tokens = F.when(blocked | cached, F.lit(0)).otherwise(
        F.get_json_object("props", "$.k").cast("int"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        pick(USER_ROLES, F.col("user_id")).alias("role"),
        model.alias("model_used"),
        F.when(blocked, F.lit("blocked")).when(cached, F.lit("cached"))
        .otherwise(pick(COMPLEXITIES, F.col("event_id"))).alias("complexity"),
        F.col("value").alias("latency_ms"),
        tokens.alias("tokens_used"),
        cost_usd(tokens, model).alias("cost_usd"),
        cached.alias("cache_hit"),
        blocked.alias("guardrail_triggered"),
        F.when(blocked, F.lit("INJECTION")).otherwise(F.lit("")).alias("guardrail_reason"),
    )


def feedback_requests(events: DataFrame) -> DataFrame:
    """events -> feedback requests: purchase +1, error -1, signup 0 (invalid)."""
    rating = (F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
              .when(F.col("event_type") == "signup", 0))
    return events.where(F.col("event_type").isin("purchase", "error", "signup")).select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chat_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        pick(USER_ROLES, F.col("user_id")).alias("role"),
        rating.cast("int").alias("rating"),
        F.repeat(F.col("props"), 60).alias("comment"),
        F.col("ts"),
        F.col("event_id").alias("id"),
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings -> (vec_id, vec array<double>, label, namespace, role, created_at)."""
    return embeddings.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        pick(NAMESPACES, F.col("label")).alias("namespace"),
        pick(USER_ROLES, F.col("vec_id")).alias("role"),
        pick(OWNER_ROLES, F.col("label")).alias("owner_role"),
        (F.lit(CACHE_BASE).cast("timestamp_ntz") + F.make_interval(
            secs=(F.col("vec_id") * CACHE_SPACING_S).cast("decimal(18,6)"))).alias("created_at"),
    )


# ---------------------------------------------------------------------------
# The same rules as DuckDB CTEs (oracle side)
# ---------------------------------------------------------------------------

def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], idx: str) -> str:
    return f"{_sql_list(values)}[((({idx}) % {len(values)}) + {len(values)}) % {len(values)} + 1]"


def sql_cost(tokens: str, model: str) -> str:
    cases = " ".join(f"WHEN '{m}' THEN {r}" for m, r in L.MODEL_RATES_E8)
    rate = f"(CASE {model} {cases} ELSE 0 END)"
    return f"((CAST({tokens} AS BIGINT) * {rate} + 50000) // 100000) / 1000000.0::DOUBLE"


SQL = {
    "chunks": f"""chunks AS (
  SELECT doc_id, text, source, source || '/doc' || CAST(doc_id AS VARCHAR) || '.md' AS file_name,
         {sql_pick(NAMESPACES, "CAST(substr(source, 4, 10) AS INTEGER)")} AS namespace, n_chars
  FROM documents)""",
    "chat_queries": f"""chat_queries AS (
  SELECT conv_id, turn, 'user' || CAST(conv_id AS VARCHAR) AS username,
         CASE WHEN ((conv_id % 2) + 2) % 2 = 1 THEN ' ' || upper({sql_pick(USER_ROLES, "conv_id")}) || ' '
              ELSE {sql_pick(USER_ROLES, "conv_id")} END AS role,
         text AS query
  FROM conversations WHERE role = 'user')""",
    "chat_answers": """chat_answers AS (
  SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')""",
    "query_metrics": f"""qm0 AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         event_type = 'error' AS blocked, event_type = 'view' AS cached,
         CASE WHEN event_type = 'error' THEN 'none' ELSE {sql_pick(MODELS, "event_id")} END AS model
  FROM events),
qm1 AS (
  SELECT *, CASE WHEN blocked OR cached THEN 0
                 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS tokens
  FROM qm0),
query_metrics AS (
  SELECT event_id AS id, ts, 'u' || CAST(user_id AS VARCHAR) AS username,
         {sql_pick(USER_ROLES, "user_id")} AS role, model AS model_used,
         CASE WHEN blocked THEN 'blocked' WHEN cached THEN 'cached'
              ELSE {sql_pick(COMPLEXITIES, "event_id")} END AS complexity,
         value AS latency_ms, tokens AS tokens_used, {sql_cost("tokens", "model")} AS cost_usd,
         cached AS cache_hit, blocked AS guardrail_triggered,
         CASE WHEN blocked THEN 'INJECTION' ELSE '' END AS guardrail_reason
  FROM qm1)""",
    "feedback_requests": f"""feedback_requests AS (
  SELECT 'c' || CAST(event_id AS VARCHAR) AS chat_id, 'u' || CAST(user_id AS VARCHAR) AS username,
         {sql_pick(USER_ROLES, "user_id")} AS role,
         CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN 0 END AS INTEGER) AS rating,
         repeat(props, 60) AS comment, ts, event_id AS id
  FROM events WHERE event_type IN ('purchase', 'error', 'signup'))""",
    "vectors": f"""vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label,
         {sql_pick(NAMESPACES, "label")} AS namespace,
         {sql_pick(USER_ROLES, "vec_id")} AS role,
         {sql_pick(OWNER_ROLES, "label")} AS owner_role,
         TIMESTAMP '{CACHE_BASE}' + to_seconds(vec_id * {CACHE_SPACING_S}) AS created_at
  FROM embeddings)""",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause holding the named CTEs (in the given order)."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"

"""Chunk-metadata upsert, index rebuild, audit sinks, JSON report.

All writes are batched DataFrame writes (never one row per call). Streaming
callers use the same functions from ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import sha256_prefix
from ..session import materialize
from . import versions


def upsert_latest(current: DataFrame | None, incoming: DataFrame, key: str = "chunk_id",
                  ts: str = "indexed_at") -> DataFrame:
    """Last write wins per key (INSERT OR REPLACE semantics), batched.

    At equal timestamps an incoming row replaces a current one; among incoming rows the one that
    sorts last by all its columns wins, so a rerun keeps the same row. A shuffle on the key and a
    row_number per key — partitioned, never global.
    """
    new = incoming.withColumn("__new", F.lit(1))
    allrows = new if current is None else current.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    plain = [c for c, kind in allrows.dtypes if "map<" not in kind]
    w = Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col("__new").desc(), F.struct(*plain).desc())
    return allrows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "__new")


#: Hash buckets of a merge target.
MERGE_BUCKETS = 64


def merge_latest(spark: SparkSession, incoming: DataFrame, path: str, key: str = "chunk_id", ts: str = "indexed_at",
                 buckets: int = MERGE_BUCKETS) -> list[int]:
    """S5 as a merge into a stored table of hash buckets of ``key``: only buckets that an incoming key falls into are read and rewritten.

    The buckets are partitions (``bucket=<n>``), so every other file stays as it is. The merged buckets are written to
    the shared folder first and then swapped in by a dynamic partition overwrite; running a merge again changes nothing.
    Returns the buckets that were rewritten (at most ``buckets`` numbers). Keep ``buckets`` as it was when the table was begun.
    """
    placed = materialize(incoming.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
    if not touched:
        return []
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    current = None
    if here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here):
        current = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = materialize(upsert_latest(current, placed, key, ts))
    (merged.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return touched


def publish_index(chunks: DataFrame, doc_chunks: DataFrame, root: str) -> int:
    """S6 published: the chunk index (by department) and its metadata become visible together, under a new version (:mod:`versions`)."""
    return versions.publish(chunks.sparkSession, root, {"chunks": chunks, "doc_chunks": doc_chunks}, {"chunks": ["department"]})


def rebuild_index(chunks: DataFrame, doc_chunks: DataFrame, index_path: str, meta_path: str) -> None:
    """Full rebuild — both the chunk index and its metadata table are rewritten together.

    The chunk index is partitioned by department so R2's ``isin`` prunes partitions.
    (The service rebuilt the store but kept stale metadata ids; we overwrite both.) A failure between the two
    writes leaves them apart: :func:`publish_index` switches both at once.
    """
    chunks.write.mode("overwrite").partitionBy("department").parquet(index_path)
    doc_chunks.write.mode("overwrite").parquet(meta_path)


def append_chat_logs(chats: DataFrame, path: str) -> None:
    """Chat audit rows; ``chunk_ids`` kept as array<string> (JSON only at a text boundary)."""
    chats.write.mode("append").parquet(path)


def chunk_ids_json(chats: DataFrame, col: str = "chunk_ids") -> DataFrame:
    """S7 boundary: the array as JSON text, as the service's TEXT column stored it."""
    return chats.withColumn(col, F.to_json(F.col(col)))


def append_metrics(metrics: DataFrame, path: str, ts: str = "ts") -> None:
    """Metrics rows partitioned by date, so time-window reads prune partitions."""
    metrics.withColumn("date", F.to_date(F.col(ts))).write.mode("append").partitionBy("date").parquet(path)


def guardrail_event_rows(df: DataFrame, query: str = "query") -> DataFrame:
    """Replace the raw text by the first 16 hex chars of its SHA-256 (no raw text kept)."""
    return df.withColumn("query_hash", sha256_prefix(F.col(query), L.QUERY_HASH_HEX_CHARS)).drop(query)


def append_guardrail_events(df: DataFrame, path: str, query: str = "query") -> None:
    guardrail_event_rows(df, query).write.mode("append").parquet(path)


def write_report(report: DataFrame, per_question: DataFrame, path: str) -> None:
    """The evaluation report as JSON: ``path/summary`` (one row) and ``path/per_question`` (a row each)."""
    report.write.mode("overwrite").json(f"{path}/summary")
    per_question.write.mode("overwrite").json(f"{path}/per_question")

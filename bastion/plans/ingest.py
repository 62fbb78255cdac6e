"""Ingestion — scan, tag, chunk, id, embed, write index and metadata."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..operators.ingest import boundary_chunks, fixed_chunks
from ..operators.vectors import hashing_embedder
from ..sources.files import load_corpus
from ..sources.sinks import publish_index, rebuild_index, upsert_latest
from ..sources.versions import current_version


def ingest(spark: SparkSession, root: str, index_path: str | None = None, meta_path: str | None = None, *,
           splitter: str = "boundary", embed: Callable[[DataFrame, str, str], DataFrame] = hashing_embedder,
           index_version: int = 1, previous_meta: DataFrame | None = None, publish_root: str | None = None):
    """Returns (chunks, doc_chunks, rejects); writes both tables when paths are given.

    ``publish_root``: publish both as the next version below it instead (S6); ``index_version`` is then that version's number.
    """
    docs, rejects = load_corpus(spark, root)
    docs = docs.withColumn("doc_key", F.concat_ws("#", "path", F.col("row").cast("string")))
    split = boundary_chunks if splitter == "boundary" else fixed_chunks
    ch = split(docs.select("doc_key", "file_name", "source", "role", "department", "text"), "text", "doc_key",
               L.CHUNK_SIZE, L.CHUNK_OVERLAP)
    if publish_root:
        index_version = (current_version(spark, publish_root) or 0) + 1
    ch = ch.withColumn("namespace", F.col("department")).withColumn("index_version", F.lit(index_version))
    ch = embed(ch, "chunk_text", "vec")
    meta = ch.select("chunk_id", "file_name", "role", "department", "source",
                     F.current_timestamp().alias("indexed_at"))
    meta = upsert_latest(previous_meta, meta)
    if publish_root:
        publish_index(ch, meta, publish_root)
    elif index_path and meta_path:
        rebuild_index(ch, meta, index_path, meta_path)
    return ch, meta, rejects

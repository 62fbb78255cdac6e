"""Operator 9: token counts by a separator scan over flat token files.

A flat token file is token ids one after another (little-endian, fixed width), with an
end-of-document id after each document and no index. It is held here as fixed-size blocks, cut
without regard to documents: rows (file, block, payload). :func:`flat_tokens` writes such files from
a table of texts, :func:`file_blocks` cuts existing raw files. :func:`separator_scan` finds the
separators of each block in one vectorised search and stitches documents that cross blocks with
a prefix scan over the blocks of a file: running sum of tokens, running maximum of the last
separator's place. The scan has two levels and sees a few numbers a block: first over groups of ``GROUP`` blocks, then
within a group, so a file of very many blocks is scanned by many tasks. Separator places (8 bytes a document) are
written once and joined with the result; tokens never leave a block.

Defined cases: null or empty text = a document of 0 tokens; texts are tokenised whole, a text's own
``<|endoftext|>`` is ordinary text; tokens after a file's last separator form a last document with
``closed`` = false; an empty file or table gives no rows; a payload of null is an empty block;
repeated ids are separate documents; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 18
#: Blocks that the second level of the scan takes together.
GROUP = 4096


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[width])


def flat_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID,
                width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of all texts, one per input partition, as a table written in the shared folder.

    Rows: file, block, payload, and ``ids``, the manifest: ids of the documents that end in the block, in order.
    The vocabulary file must be readable at ``vocabulary`` on every worker.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = _kind(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size, ids = 0, []

        def cut(tokens: np.ndarray, done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([tokens.tobytes()], pa.binary()),
                pa.array([done], pa.list_(pa.int64()))], ["file", "block", "payload", "ids"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                held.append(np.asarray([*coder.encode_ordinary(text.as_py()), end_id], dtype=kind))
                size += len(held[-1])
                while size > block_tokens:
                    flat = np.concatenate(held)
                    yield cut(flat[:block_tokens], ids)  # the document at hand ends in a later block
                    block, held, size, ids = block + 1, [flat[block_tokens:]], size - block_tokens, []
                ids.append(i.as_py())
        if size:
            yield cut(np.concatenate(held), ids)

    C.prepare(df.sparkSession)
    return C.stage(texts.mapInArrow(run, "file int, block long, payload binary, ids array<long>"), "tokens")


def file_blocks(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Raw flat token files under ``path`` as rows (file, block, payload); a file must be under 2 GB (Spark's binary source).

    A file's blocks are handed on one after another as slices of its content.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_buffer()
                for block in range(max(1, -(-raw.size // size))):
                    part = raw.slice(block * size, min(size, raw.size - block * size))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([block], pa.int64()), pa.array([part.to_pybytes()], pa.binary())],
                                                     ["file", "block", "payload"])

    return files.mapInArrow(run, "file string, block long, payload binary")


def block_offsets(blocks: DataFrame) -> DataFrame:
    """(file, block, base, first, last) from rows (file, block, tokens, n, at): tokens and documents before each block, and the place
    of the last separator before it (-1: none). ``n``: separators of the block, ``at``: the last one's place in it, null if none."""
    rows = blocks.withColumn("part", F.floor(F.col("block") / GROUP))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    groups, within = before(["file"], "part"), before(["file", "part"], "block")
    sums = rows.groupBy("file", "part").agg(F.sum("tokens").alias("t"), F.sum("n").alias("k"))
    sums = sums.select("file", "part", start("t", groups).alias("t"), start("k", groups).alias("k"))
    rows = (rows.join(sums, ["file", "part"]).withColumn("base", F.col("t") + start("tokens", within))
            .withColumn("first", F.col("k") + start("n", within)).withColumn("place", F.col("base") + F.col("at")))
    lasts = rows.groupBy("file", "part").agg(F.max("place").alias("place"))
    lasts = lasts.select("file", "part", F.coalesce(F.max("place").over(groups), F.lit(-1)).alias("earlier"))
    return rows.join(lasts, ["file", "part"]).select(
        "file", "block", "base", "first", F.greatest("earlier", F.coalesce(F.max("place").over(within), F.lit(-1))).alias("last"))


def separator_scan(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, begin, n_tokens, closed) of each document, from rows (file, block, payload).

    ``begin``: place of the document's first token in the file; separators count in no document.
    """
    kind = _kind(width)
    given = blocks.select("file", "block", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = [np.frombuffer(p.as_buffer() if p.is_valid else b"", dtype=kind) for p in batch.column(2)]
            ends = [np.flatnonzero(f == end_id) for f in flats]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(f) for f in flats], pa.int64()),
                pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    file_type = given.schema["file"].dataType.simpleString()
    found = C.stage(given.mapInArrow(run, f"file {file_type}, block long, tokens long, ends array<long>"), "separators")
    last_end = F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)
    narrow = found.select("file", "block", "tokens", F.size("ends").alias("n"), last_end.alias("at"))
    scan = found.join(block_offsets(narrow), ["file", "block"])
    place = scan.select("file", "first", "last", F.transform("ends", lambda e: e + F.col("base")).alias("place"))
    closed = place.select("file", "first", "last", "place", F.posexplode("place").alias("k", "end")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("place", F.col("k") - 1)) + 1).alias("begin"), "end")
    tail = (scan.groupBy("file").agg(F.sum("tokens").alias("end"), F.sum(F.size("ends")).alias("ordinal"),
                                     F.coalesce(F.max(F.col("base") + last_end), F.lit(-1)).alias("last"))
            .where("end > last + 1").select("file", F.col("ordinal"), (F.col("last") + 1).alias("begin"), "end"))
    return (closed.withColumn("closed", F.lit(True)).union(tail.withColumn("closed", F.lit(False)))
            .select("file", "ordinal", "begin", (F.col("end") - F.col("begin")).alias("n_tokens"), "closed"))


def manifest(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, id) from the ids kept beside the blocks; the scan sees their numbers only."""
    none = F.lit(None).cast("long")
    narrow = blocks.select("file", "block", F.lit(0).cast("long").alias("tokens"), F.size("ids").alias("n"), none.alias("at"))
    first = block_offsets(narrow).select("file", "block", "first")
    return (blocks.select("file", "block", "ids").join(first, ["file", "block"])
            .select("file", "first", F.posexplode("ids").alias("k", "id"))
            .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "id"))


def op9_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = flat_tokens(C.read(spark, sf_dir, "documents"))
    return separator_scan(blocks).join(manifest(blocks), ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "file", "ordinal", "n_tokens")


QUERIES = {"op9_separator_token_counts": op9_separator_token_counts}

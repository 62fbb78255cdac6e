"""V1, V2: chunking and deterministic chunk ids.

``fixed_chunks`` is the native, oracle-checkable splitter: windows of ``size``
characters stepping ``size - overlap``; the last start is ``n - overlap`` so no
chunk is only overlap. ``boundary_chunks`` ends its windows at the best break in reach
(paragraph, line, sentence, space), as a fold over each whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import strip


def chunk_id(doc_key, pos) -> F.Column:
    """V2: sha256 of 'doc|pos' — re-ingest gives the same ids."""
    return F.sha2(F.concat_ws("|", F.col(doc_key).cast("string"), F.col(pos).cast("string")), 256)


def fixed_chunks(docs: DataFrame, text: str = "text", doc_key: str = "doc_id", size: int = L.CHUNK_SIZE,
                 overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))
    out = docs.where(F.length(text) > 0).select("*", F.posexplode(starts).alias("pos", "start"))
    out = out.withColumn("chunk_text", F.expr(f"substring({text}, start, {size})"))
    return out.withColumn("pos", F.col("pos").cast("int")).withColumn("start", F.col("start").cast("int")) \
        .withColumn("chunk_id", chunk_id(doc_key, "pos"))


#: Places to end a chunk at, best first.
BREAKS = ("\n\n", "\n", ". ", " ")


def split_text(text: str, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP) -> list[str]:
    """In plain Python, for one text and for tests: windows of at most ``size`` characters that end at the best break in reach and overlap by whole words.

    A window ends after the last paragraph break that leaves it longer than the overlap, else the last line
    break, sentence end or space, else it is cut. The next one begins at the first word of the last ``overlap``
    characters.
    """
    out: list[str] = []
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            ends = (text.rfind(mark, lo + overlap, hi) + len(mark) for mark in BREAKS if text.rfind(mark, lo + overlap, hi) >= 0)
            hi = next((e for e in ends if lo + overlap < e <= hi), hi)
        piece = text[lo:hi].strip()
        if piece:
            out.append(piece)
        if hi == len(text):
            break
        word = text.find(" ", hi - overlap, hi - 1)
        lo = word + 1 if word >= 0 else hi - overlap
    return out


#: Code points of the blocks that a text is read in while it is cut.
READ_BLOCK = 8192


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(state: Column, blocks: Column, n: Column, size: int, overlap: int) -> Column:
    """One window further: (lo, out) with the window's stripped piece appended, lo = -1 after the last."""
    lo = state["lo"]
    at = F.floor(lo / READ_BLOCK).cast("int")
    window = F.substring(F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit(""))), lo - at * READ_BLOCK + 1, F.lit(size))

    def end(w: Column) -> Column:
        """Characters of the window up to the best break in reach."""
        tail = F.substring(w, overlap + 1, size - overlap)
        hi = F.lit(size)
        for mark in reversed(BREAKS):
            after = F.locate(mark[::-1], F.reverse(tail))  # from the end
            hi = F.when(after > 0, F.lit(size + 1) - after).otherwise(hi)
        return F.when(lo + size >= n, n - lo).otherwise(hi).cast("int")

    def step(w: Column) -> Column:
        return _let(end(w), lambda e: F.struct(
            F.when(lo + e >= n, F.lit(-1)).otherwise(
                lo + e - overlap + F.locate(" ", F.substring(w, e - overlap + 1, F.lit(overlap - 1)))).cast("int").alias("lo"),
            _let(strip(F.substring(w, F.lit(1), e)), lambda piece: F.when(piece != "", F.concat(state["out"], F.array(piece))).otherwise(state["out"])).alias("out")))

    return _let(window, step)


def boundary_chunks(docs: DataFrame, text: str = "text", doc_key: str = "doc_id", size: int = L.CHUNK_SIZE,
                    overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    """V1 boundary-aware variant: the windows of :func:`split_text` as a fold in Spark expressions (one pass, no shuffle, no Python).

    A text is read in blocks, so a window costs a block and not the whole text. Of len(BREAKS) + 1 windows in a row one at least
    ends beyond the reach of the first (the last break of a kind in reach is taken, so each of the others must end at
    a lesser kind), which bounds the number of steps.
    """
    keep = [c for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(*keep, F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{READ_BLOCK}}}"), F.lit(0)).alias("__blocks"), F.char_length(whole).alias("__n"))
    steps = (F.ceil(F.col("__n") / (size - overlap)).cast("int") + 1) * (len(BREAKS) + 1)
    start = F.struct(F.lit(0).alias("lo"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(1), steps), start, lambda s, _: F.when(s["lo"] < 0, s).otherwise(
        _cut(s, F.col("__blocks"), F.col("__n"), size, overlap)))
    out = read.where("__n > 0").select(*keep, F.posexplode(done["out"]).alias("pos", "chunk_text"))
    return out.withColumn("chunk_id", chunk_id(doc_key, "pos"))

"""Operator 13: vector code compression by active-entry Lloyd rounds.

Components become integers floor(SCALE * x). A vector is cut into ``PARTS`` equal consecutive parts, and each part
position has a codebook of ``ENTRIES`` integer entries, which starts as that part of the vectors with the smallest ids.
A round gives every part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces
each entry by the componentwise floor(sum / count) of its parts; an unused entry stays. After the last round parts
are given out once more.

Every part keeps its entry and its exact distance from one round to the next, beside the vector in the staged table.
If the entry of a part did not move in the last update, its distance still holds and lies at or below that to all
other unmoved entries, so the part is compared with the moved entries only; all other parts are compared with all
entries. Sums are integers: each task adds its parts up and writes one row of sums into the same table; Spark adds these rows,
and the driver sees PARTS * ENTRIES * (width + 1) numbers a round, whatever the data. A round reads one staged table
and writes the next, and the one before is deleted, so a lost executor costs a part of one round.

Defined cases: a row whose vector is null or holds a null or non-finite component is left out. The vectors' length is that
of the kept vector with the smallest id (then the smallest vector) among those of a positive multiple of PARTS; a vector of
another length, or with a component beyond +-2**27 after scaling, takes no part and has a null code and error.
Null ids come last among the seeds; rows with equal ids are ordered by vector; repeated rows stay rows; with fewer vectors
than ENTRIES there are as many entries as vectors; an empty table gives an empty result. Of the other columns those named in
``keep`` pass through, whatever their names, unless they are called ``code`` or ``error``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import common as C

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Scaled components lie below this, so that squared distances and a task's sums fit 64 bits.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is neither null nor has a null or non-finite component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null if one lies beyond LARGEST."""
    big = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return F.when(F.forall(big, lambda x: F.abs(x) < F.lit(float(LARGEST))), F.transform(
        big, lambda x: F.when(F.abs(x) < F.lit(float(LARGEST)), x).cast("int")))


# ---------------------------------------------------------------- a round

def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of ``entries`` (k x width) to each row, ties to the lower index."""
    gap = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    at = gap.argmin(axis=1)
    return at, gap[np.arange(len(x)), at]


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New entry and distance of each row from those of the round before; also the number of comparisons made."""
    code, gap = code.copy(), gap.copy()
    fixed, active = ~moved[code], np.flatnonzero(moved)
    again = np.flatnonzero(~fixed)
    if len(again):
        code[again], gap[again] = nearest(x[again], entries)
    held = np.flatnonzero(fixed)
    if len(held) and len(active):
        at, near = nearest(x[held], entries[active])
        at = active[at]
        better = (near < gap[held]) | ((near == gap[held]) & (at < code[held]))
        code[held[better]], gap[held[better]] = at[better], near[better]
    return code, gap, len(again) * len(entries) + len(held) * len(active)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Rows (id, keep, ints, code, gap, sums) with new codes and distances; each task adds one row that holds its sums only.

    ``moved`` (parts x entries): which entries the last update changed; None: there was none, all are compared.
    """
    parts, entries, width = books.shape
    kept = [f for f in rows.schema.fields if f.name in ("id", "keep", "ints")]
    out = StructType([*kept, StructField("code", BinaryType()), StructField("gap", ArrayType(LongType())), StructField("sums", ArrayType(LongType()))])
    base = rows.select("id", "keep", "ints", *(["code", "gap"] if moved is not None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            x = _matrix(batch.column(2))
            n = len(x)
            if moved is not None:
                code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                gap = _matrix(batch.column(4))
            new_code, new_gap = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
            for p in range(parts):
                part = x[:, p * width:(p + 1) * width]
                if moved is None:
                    new_code[:, p], new_gap[:, p] = nearest(part, books[p])
                else:
                    new_code[:, p], new_gap[:, p], _ = reassign(part, books[p], moved[p], code[:, p], gap[:, p])
                for k in range(width):  # a batch's sums are exact in doubles
                    sums[p, :, k] += np.bincount(new_code[:, p], weights=part[:, k], minlength=entries).astype(np.int64)
                sums[p, :, width] += np.bincount(new_code[:, p], minlength=entries)
            columns = [*batch.columns[:3], pa.array([r.tobytes() for r in new_code.astype(np.uint8)], pa.binary()),
                       pa.array(new_gap.tolist(), pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            done = pa.RecordBatch.from_arrays(columns, ["id", "keep", "ints", "code", "gap", "sums"])
            schema = done.schema
            yield done
        if schema is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([sums.reshape(-1).tolist()], pa.list_(pa.int64()))],
                                             schema.names)

    return base.mapInArrow(run, out)


def updated(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floor(sum / count) of each used entry, by exact integers."""
    parts, entries, width = books.shape
    totals = {r["pos"]: int(r["s"]) for r in table.where("sums is not null").select(F.posexplode("sums")).groupBy("pos")
              .agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}  # parts * entries * (width + 1) rows
    new = books.copy()
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if count := totals[at + width]:
                new[p, e] = [totals[at + k] // count for k in range(width)]
    return new


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(id_col, *keep, code, error) of every kept row, and the codebooks (parts x entries x width; None without vectors).

    ``code``: two hex digits a part. ``error``: the squared distances summed over the parts. ``entries`` <= 256.
    """
    spark = df.sparkSession
    C.prepare(spark)
    vector, keep = F.col(vector_col), tuple(k for k in keep if k not in (id_col, "code", "error"))
    rows = df.where(finite(vector)).select(
        F.col(id_col).alias("id"), F.struct(F.lit(0).alias("__llm"), *keep).alias("keep"), scaled(vector, scale).alias("ints"))
    rows = C.stage(rows, "scaled")
    fits = F.col("ints").isNotNull() & (F.size("ints") > 0) & (F.size("ints") % parts == 0)
    order = [F.col("id").asc_nulls_last(), F.col("ints")]
    first = rows.where(fits).orderBy(*order).select(F.size("ints").alias("n")).first()
    books, table = None, None
    length = first["n"] if first else -1
    if first:
        usable = rows.where(fits & (F.size("ints") == length))
        seeds = [r["ints"] for r in usable.orderBy(*order).limit(entries).select("ints").collect()]  # ``entries`` rows
        books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
        table, moved = usable, None
        for turn in range(rounds + 1):
            after = C.stage(_round(table if turn == 0 else table.where("sums is null"), books, moved), "lloyd")
            if turn:
                C.unstage(table)
            table = after
            if turn < rounds:
                new = updated(table, books)
                moved, books = (new != books).any(axis=2), new
    kept = [F.col("id").alias(id_col), *[F.col("keep").getField(k).alias(k) for k in keep]]
    other = rows.where(~F.coalesce(fits & (F.size("ints") == length), F.lit(False))).select(
        *kept, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if table is None:
        return other, None
    done = table.where("sums is null").select(
        *kept, F.lower(F.hex("code")).alias("code"), F.aggregate("gap", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    return done.union(other), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in (books.reshape(-1) if books is not None else ())).encode()).hexdigest()


def op13_active_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(C.read(spark, sf_dir, "embeddings"), keep=("label",))
    # few labels: their totals take one row each
    totals = codes.groupBy(F.col("label").alias("__llm_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("__llm_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op13_active_lloyd_codes": op13_active_lloyd_codes}


def _oracle() -> str:
    width = f"(len(embedding) // {PARTS})"
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, list_transform(embedding[part * {width} + 1:(part + 1) * {width}],
    lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM kept, range({PARTS}) AS t(part)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry, x FROM parts
  QUALIFY entry < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
given{r} AS MATERIALIZED (
  SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.x) AS x,
    min(CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {ENTRIES} + b.entry) AS best
  FROM parts p JOIN book{r} b ON p.part = b.part GROUP BY p.vec_id, p.part)""")
        if r < ROUNDS:
            steps.append(f"""
mean{r} AS (
  SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY k) AS x FROM (
    SELECT part, best % {ENTRIES} AS entry, k, sum(x[k]) AS s, count(*) AS n
    FROM given{r}, range(1, 4097) AS t(k) WHERE k <= len(x) GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return ",".join(steps) + f""",
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code,
    CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM given{ROUNDS} GROUP BY vec_id),
labels_of AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)
SELECT c.vec_id, c.code, c.error, l.label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(v AS VARCHAR)), ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded c JOIN labels_of l ON c.label IS NOT DISTINCT FROM l.label
"""


ORACLE = {"op13_active_lloyd_codes": _oracle()}

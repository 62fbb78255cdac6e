"""V3-V6: vector functions and distributed exact / approximate top-k joins.

Two exact strategies produce the same rows:

* :func:`topk_join` — pure DataFrame: equi-join on a key (namespace, time
  bucket…), dot product with higher-order functions, ``row_number`` per query
  (Spark inserts a partial ``WindowGroupLimit`` before the shuffle). Simple and
  oracle-friendly, but it materialises every (query, item) pair sharing a key.
* :func:`block_topk` — the scale path: both sides are cut into bounded blocks
  (items by hash of id, queries likewise), each query block is co-grouped with
  each item block of the same key, and a vectorised numpy kernel computes the
  block's similarity matrix and keeps only the top-k per query. Pairs are never
  rows. The number of item blocks is set per key from a per-key count, so a hot
  key (one namespace holding a third of all chunks) is spread over as many
  blocks as its size needs, a small key gets one, and a query is copied only to
  the blocks of the keys it may read. No task holds an unbounded group.

The final merge is a ``row_number`` over at most (#item blocks of the query's
keys x k) candidates per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_of, epoch_us

# ---------------------------------------------------------------------------
# Column functions
# ---------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(col_of(a), lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """V4: cosine similarity; 0 when either is empty/NULL, lengths differ, or a norm is 0."""
    a, b = col_of(a), col_of(b)
    na, nb = norm(a), norm(b)
    ok = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0) & (F.size(a) == F.size(b))
    return F.when(ok & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def normalize(a: Column | str) -> Column:
    """Unit-length copy (zero vector stays zero), so cosine becomes a dot product."""
    a = col_of(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


# ---------------------------------------------------------------------------
# Exact top-k, pure DataFrame
# ---------------------------------------------------------------------------


def topk_join(queries: DataFrame, items: DataFrame, k: int, *, q_id: str, i_id: str, key: str | None = None,
              q_vec: str = "vec", i_vec: str = "vec", tie: str | None = None, exclude_self: bool = False,
              digits: int = 6) -> DataFrame:
    """Exact top-k by cosine via an equi-join on ``key`` (required: no keyless cross join)."""
    if key is None:
        raise ValueError("topk_join needs an equi key; use block_topk for keyless search")
    tie = tie or i_id
    q = queries.select(F.col(q_id).alias("__q"), F.col(q_vec).alias("__qv"), F.col(key).alias("__k"))
    i = items.select(F.col(i_id).alias("__i"), F.col(i_vec).alias("__iv"), F.col(key).alias("__k"),
                     F.col(tie).alias("__t"))
    j = q.join(i, "__k")
    if exclude_self:
        j = j.where(F.col("__q") != F.col("__i"))
    j = j.withColumn("score", F.round(cosine("__qv", "__iv"), digits))
    w = Window.partitionBy("__q").orderBy(F.col("score").desc(), F.col("__t"), F.col("__i"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .select(F.col("__q").alias(q_id), F.col("__i").alias(i_id), "score", "rank"))


# ---------------------------------------------------------------------------
# Exact top-k, blocked numpy kernel
# ---------------------------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    """Unit rows of ``m``, in place; a row without a direction becomes zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    np.divide(m, n, out=m, where=n > 0)
    m[~(n[:, 0] > 0)] = 0.0
    return m


def _by_length(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of each vector length; NULL and empty vectors are in none."""
    lengths = np.array([0 if v is None else len(v) for v in vectors])
    values = vectors.to_numpy()
    return {int(d): (at, _unit(np.stack(values[at], dtype=np.float64, casting="unsafe")))
            for d in np.unique(lengths[lengths > 0]) for at in [np.flatnonzero(lengths == d)]}


def _select_topk(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) candidates holding each row's top-k finite scores, ties at the k-th kept.

    Vectorised: one argpartition per chunk. Only rows whose k-th score is tied with
    scores outside the partition take an exact per-row path (rare).
    """
    m, n = s.shape
    kk = min(k, n)
    idx = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
    kth = np.take_along_axis(s, idx, axis=1).min(axis=1)
    n_ge = (s >= kth[:, None]).sum(axis=1)
    simple = (n_ge <= kk) | ~np.isfinite(kth)
    rows = [np.repeat(np.nonzero(simple)[0], kk)]
    cols = [idx[simple].ravel()]
    for r in np.nonzero(~simple)[0]:
        c = np.nonzero(s[r] >= kth[r])[0]
        rows.append(np.full(c.size, r))
        cols.append(c)
    rr, cc = np.concatenate(rows), np.concatenate(cols)
    ok = np.isfinite(s[rr, cc])
    return rr[ok], cc[ok]


def _reaching(s: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of the finite scores that can be among their row's k best once rounding has moved them by ``slack`` at most.

    The k-th best of the maxima of groups of columns is a lower bound of the k-th best score: one pass over the scores, no
    sorting of them.
    """
    m, n = s.shape
    width = max(1, min(64, n // (4 * k)))
    groups = n // width
    if groups < k:
        r, c = np.nonzero(np.isfinite(s))
        return r, c
    tops = s[:, :groups * width].reshape(m, groups, width).max(axis=2)
    bound = np.partition(tops, groups - k, axis=1)[:, groups - k]
    r, c = np.nonzero(s >= bound[:, None] - slack)
    ok = np.isfinite(s[r, c])
    return r[ok], c[ok]


def _kernel(k: int, digits: int, exclude_self: bool, max_age_us: int | None, min_score: float | None,
            max_cells: int = 1_000_000):
    """Block scorer: cosine of every (query, item) pair of the block, top-k per query.

    Queries are processed in chunks of at most ``max_cells`` matrix cells, so a
    block of 50k x 50k allocates a few MB at a time besides its vectors.
    """
    def empty() -> pd.DataFrame:
        return pd.DataFrame({"__q": pd.Series([], dtype="int64"), "__i": pd.Series([], dtype="int64"),
                             "score": pd.Series([], dtype="float64"), "__t": pd.Series([], dtype="int64")})

    def run(qdf: pd.DataFrame, idf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or idf.empty:
            return empty()
        iparts, qparts = _by_length(idf["__iv"]), _by_length(qdf["__qv"])
        iid, itie, itime = (idf[c].to_numpy(np.int64) for c in ("__i", "__t", "__ts"))
        qids, qtime = (qdf[c].to_numpy(np.int64) for c in ("__q", "__ts"))
        step = max(1, max_cells // max(1, len(idf)))
        out = []
        for start in range(0, len(qdf), step):
            qid = qids[start:start + step]
            # unequal lengths, NULL and empty vectors -> similarity 0 (V4)
            s = None
            for d, (qpos, qm) in qparts.items():
                lo, hi = np.searchsorted(qpos, [start, start + len(qid)])
                if d in iparts and hi > lo:
                    ipos, im = iparts[d]
                    if hi - lo == len(qid) and len(ipos) == len(iid):
                        s = qm[lo:hi] @ im.T
                    else:
                        s = np.zeros((len(qid), len(iid))) if s is None else s
                        s[np.ix_(qpos[lo:hi] - start, ipos)] = qm[lo:hi] @ im.T
            s = np.zeros((len(qid), len(iid))) if s is None else s
            if exclude_self:
                s[qid[:, None] == iid[None, :]] = -np.inf
            if max_age_us is not None:
                age = qtime[start:start + step, None] - itime[None, :]
                s[(age <= 0) | (age >= max_age_us)] = -np.inf
            rr, cc = _reaching(s, k, 2 * 10.0 ** -digits)
            sc = np.round(s[rr, cc], digits)
            if min_score is not None:  # those below come after all others: the k best keep their places
                keep = sc > min_score
                rr, cc, sc = rr[keep], cc[keep], sc[keep]
            if rr.size == 0:
                continue
            order = np.lexsort((iid[cc], itie[cc], -sc, rr))
            rr, cc, sc = rr[order], cc[order], sc[order]
            first = np.r_[True, rr[1:] != rr[:-1]]
            start_of = np.maximum.accumulate(np.where(first, np.arange(rr.size), 0))
            keep = (np.arange(rr.size) - start_of) < k
            rr, cc, sc = rr[keep], cc[keep], sc[keep]
            out.append(pd.DataFrame({"__q": qid[rr], "__i": iid[cc], "score": sc, "__t": itie[cc]}))
        return pd.concat(out, ignore_index=True) if out else empty()
    return run


def block_topk(queries: DataFrame, items: DataFrame, k: int, *, q_id: str, i_id: str,
               q_key: str | None = None, i_key: str | None = None, q_vec: str = "vec", i_vec: str = "vec",
               tie: str | None = None, exclude_self: bool = False, q_time: str | None = None,
               i_time: str | None = None, max_age_s: float | None = None, min_score: float | None = None,
               item_block_rows: int = 50_000, query_block_rows: int = 50_000, digits: int = 6,
               bounded_keys: bool = False) -> DataFrame:
    """Exact top-k items per query by cosine, computed block by block.

    ``q_key``/``i_key``: the equi key (e.g. namespace); a query may appear in
    several rows with different keys (one per allowed namespace). ``tie`` orders
    equal scores (default the item id; the id always breaks remaining ties).
    ``q_time``/``i_time``/``max_age_s``: keep items with ``0 < q_time - i_time <
    max_age_s`` (cache TTL semantics). ``min_score``: keep only ``score >
    min_score`` (strict). Scores are rounded to ``digits`` before ranking.
    Block counts per key come from per-key count aggregates on both sides.
    ``bounded_keys``: the caller knows that the keys are a fixed dimension (at most
    thousands, e.g. namespaces); the per-key counts are then broadcast, so that no side
    is shuffled on the key alone. Leave it off for TTL or LSH keys, whose number grows.
    Ids must be integral (the kernel works on int64 arrays); key string ids first.
    Returns (q_id, i_id, score, rank).
    """
    if q_id == i_id:
        raise ValueError("q_id and i_id must differ; rename one side for a self-join")
    integral = ("bigint", "int", "smallint", "tinyint")
    for df, name in ((queries, q_id), (items, i_id)):
        if dict(df.dtypes).get(name) not in integral:
            raise TypeError(f"block_topk needs an integral id column, got {name}: {dict(df.dtypes).get(name)}")
    tie = tie or i_id
    timed = max_age_s is not None
    tie_col = F.col(tie)
    if dict(items.dtypes).get(tie, "") in ("timestamp", "timestamp_ntz"):
        tie_col = epoch_us(items, tie)
    qcols = [F.col(q_id).cast("long").alias("__q"), F.col(q_vec).cast("array<double>").alias("__qv"),
             (F.col(q_key).cast("string") if q_key else F.lit("")).alias("__k")]
    icols = [F.col(i_id).cast("long").alias("__i"), F.col(i_vec).cast("array<double>").alias("__iv"),
             (F.col(i_key).cast("string") if i_key else F.lit("")).alias("__k"), tie_col.cast("long").alias("__t")]
    if timed:
        qcols.append(epoch_us(queries, q_time).alias("__ts"))
        icols.append(epoch_us(items, i_time).alias("__ts"))
    i0 = items.select(*icols)
    q0 = queries.select(*qcols)

    def nblocks(n, rows):
        return F.greatest(F.lit(1), F.ceil(n / F.lit(rows))).cast("int")

    if q_key and i_key:
        # Block counts per key from per-key counts on both sides (partial aggregates, one
        # row per key): a hot key gets many blocks, a small key one; a query is copied
        # only to the item blocks of its own keys and an item to the query blocks of its
        # key, so replication follows the work. Keys missing on either side drop out.
        ic = i0.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).select("__k", nblocks(F.col("__n"), item_block_rows)
                                                                          .alias("__nb"))
        qc = q0.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).select("__k", nblocks(F.col("__n"), query_block_rows)
                                                                          .alias("__nqb"))
        blocks = ic.join(qc, "__k")
        if bounded_keys:
            blocks = F.broadcast(blocks)
        q0 = q0.join(blocks, "__k")
        i0 = i0.join(blocks, "__k")
    else:
        raise ValueError("block_topk needs a key on both sides (namespace, time bucket, LSH bucket)")
    # The co-group keys must have identical types on both sides: the shuffle hashes
    # them, and a bigint 0 and an int 0 land in different partitions.
    q = q0.withColumn("__qb", F.pmod(F.xxhash64("__q"), F.col("__nqb")).cast("int")) \
        .withColumn("__ib", F.explode(F.sequence(F.lit(0), F.col("__nb").cast("int") - 1))).drop("__nb", "__nqb")
    i = i0.withColumn("__ib", F.pmod(F.xxhash64("__i"), F.col("__nb")).cast("int")) \
        .withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__nqb").cast("int") - 1))).drop("__nb", "__nqb")
    if not timed:
        q = q.withColumn("__ts", F.lit(0).cast("long"))
        i = i.withColumn("__ts", F.lit(0).cast("long"))
    kern = _kernel(k, digits, exclude_self, int(max_age_s * 1_000_000) if timed else None, min_score)
    cand = (q.groupBy("__k", "__qb", "__ib").cogroup(i.groupBy("__k", "__qb", "__ib"))
            .applyInPandas(kern, "__q long, __i long, score double, __t long"))
    w = Window.partitionBy("__q").orderBy(F.col("score").desc(), F.col("__t"), F.col("__i"))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select(F.col("__q").alias(q_id), F.col("__i").alias(i_id), "score", "rank"))


# ---------------------------------------------------------------------------
# V3: default embedder, V6: approximate join
# ---------------------------------------------------------------------------


def hashing_embedder(df: DataFrame, text: str, out: str = "vec", dim: int = 256) -> DataFrame:
    """V3 default: RegexTokenizer -> HashingTF -> L2 Normalizer, all Spark ML (JVM)."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"(?U)\W+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    nm = Normalizer(inputCol="__tf", outputCol="__nv", p=2.0)
    res = nm.transform(tf.transform(tok.transform(df)))
    return res.withColumn(out, vector_to_array("__nv")).drop("__tok", "__tf", "__nv")


def lsh_keys(df: DataFrame, dim: int, vec: str = "vec", bits: int = 8, tables: int = 8, seed: int = 7,
             out: str = "lsh_key", key: str | None = None) -> DataFrame:
    """One row per (row, LSH table) with a bucket key: the signs of ``bits`` random projections.

    Rows that share a key in any table are candidates. 2**bits buckets per table: choose ``bits``
    with the data (about log2(rows / block size)), so that buckets keep their size as data grow.
    ``key`` (e.g. a namespace) goes into the bucket key, so candidates share it. Vectors that are
    NULL or not of length ``dim`` have no direction and get no bucket.
    """
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    @F.pandas_udf("array<string>")
    def buckets(column: pd.Series) -> pd.Series:
        good = np.array([v is not None and len(v) == dim for v in column], dtype=bool)
        found = [None] * len(column)
        if good.any():
            signs = np.stack(column.to_numpy()[good]).astype(np.float64) @ planes.T > 0
            codes = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits))
            for at, row in zip(np.flatnonzero(good), codes):
                found[at] = [f"{t}:{c}" for t, c in enumerate(row)]
        return pd.Series(found)

    keyed = df.withColumn("__b", F.explode(buckets(F.col(vec).cast("array<double>"))))
    name = F.concat_ws("|", F.col(key).cast("string"), "__b") if key else F.col("__b")
    return keyed.withColumn(out, name).drop("__b")


def approx_topk(queries: DataFrame, items: DataFrame, k: int, *, q_id: str, i_id: str, dim: int, q_key: str | None = None,
                i_key: str | None = None, q_vec: str = "vec", i_vec: str = "vec", bits: int = 8, tables: int = 8,
                seed: int = 7, exclude_self: bool = False, **kw) -> DataFrame:
    """V6: approximate top-k — exact scoring only among LSH-bucket mates, block by block.

    ``q_key``/``i_key`` (both or neither): candidates must also share this key, so access filters
    hold; a query may come with several keys. A pair found in several tables is kept once. Extra
    ``q_*``/``i_*`` columns named in ``kw`` (times) are carried. Returned scores are exact.
    """
    other = i_id if i_id != q_id else f"{i_id}_match"
    carry = [c for c in (kw.get("q_time"),) if c]
    icarry = [c for c in (kw.get("i_time"), kw.get("tie")) if c]
    qk = lsh_keys(queries.select(q_id, q_vec, *({q_key} - {None}), *carry), dim, q_vec, bits, tables, seed, key=q_key)
    ik = lsh_keys(items.select(F.col(i_id).alias(other), i_vec, *({i_key} - {None}), *dict.fromkeys(icarry)), dim, i_vec, bits, tables,
                  seed, key=i_key)
    cand = block_topk(qk, ik, k * tables, q_id=q_id, i_id=other, q_key="lsh_key", i_key="lsh_key",
                      q_vec=q_vec, i_vec=i_vec, exclude_self=exclude_self, **kw)
    dedup = cand.dropDuplicates([q_id, other])
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(other))
    return dedup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

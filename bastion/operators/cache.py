"""Semantic cache as batch joins.

Batch lookups treat the cache as a table of entries and every query as a probe
at its own time: the arg-max is computed by the blocked top-k kernel (k = 1)
restricted to entries created before the query and younger than the TTL; the
threshold and the access test are applied to that single best entry, in that
order (an inaccessible best is a miss even if the runner-up would pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import epoch_us
from .access import allowed_namespaces, can_access, is_unrestricted
from .vectors import approx_topk, block_topk

#: TTLs to a bucket: a bucket is one call of the kernel, whose cost on few rows is that of the call.
TTL_SPANS = 6


def _ttl_buckets(queries: DataFrame, q_time: str, entries: DataFrame, e_time: str, ttl_s: float):
    """Interval-join keys: entries live in buckets of ``TTL_SPANS`` TTLs; a query probes its own bucket and, within a TTL of
    its beginning, the one before, which hold every entry with 0 < age < ttl."""
    ttl_us = int(ttl_s * 1_000_000)
    at = epoch_us(queries, q_time)
    bucket = lambda t: F.floor(t / (TTL_SPANS * ttl_us)).cast("long").cast("string")
    q = queries.withColumn("__tb", F.explode(F.array_distinct(F.array(bucket(at), bucket(at - ttl_us)))))
    e = entries.withColumn("__tb", bucket(epoch_us(entries, e_time)))
    return q, e


def lookup(queries: DataFrame, entries: DataFrame, *, q_id: str = "query_id", q_vec: str = "vec",
           q_time: str = "ts", role: str = "role", e_id: str = "entry_id", e_vec: str = "vec",
           e_time: str = "created_at", owner_role: str = "owner_role", ttl_s: float = L.CACHE_TTL_SECONDS,
           threshold: float = L.CACHE_THRESHOLD, strict_namespaces: bool = False, **kw) -> DataFrame:
    """C1 (+C2): best live entry per query; hit iff sim >= threshold and R4(role, owner).

    An interval join: both sides are keyed by TTL-sized time buckets, so a query is
    scored only against entries of its own and the previous bucket.

    Best = highest cosine strictly above 0; ties go to the earliest entry. With
    ``strict_namespaces`` the asker must also be allowed every namespace of the owner
    (closes the finance-reads-hr-answer gap); the unrestricted role always may.
    Returns (q_id, e_id, sim, hit).
    """
    qk, ek = _ttl_buckets(queries.select(q_id, q_vec, q_time), q_time,
                          entries.select(e_id, e_vec, e_time), e_time, ttl_s)
    best = block_topk(qk, ek, 1, q_id=q_id, i_id=e_id, q_key="__tb", i_key="__tb", q_vec=q_vec, i_vec=e_vec,
                      tie=e_time, q_time=q_time, i_time=e_time, max_age_s=ttl_s, min_score=0.0, **kw)
    best = best.select(q_id, e_id, F.col("score").alias("sim"))
    q = queries.select(q_id, role)
    e = entries.select(e_id, owner_role)
    j = q.join(best, q_id, "left").join(e, e_id, "left")
    ok = can_access(role, owner_role)
    if strict_namespaces:
        beyond = F.array_except(allowed_namespaces(owner_role), allowed_namespaces(role))
        ok = ok & (is_unrestricted(role) | (F.size(beyond) == 0))
    hit = F.coalesce((F.col("sim") >= threshold) & ok, F.lit(False))
    return j.select(q_id, e_id, "sim", hit.alias("hit"))


def live_entries(entries: DataFrame, as_of, ttl_s: float = L.CACHE_TTL_SECONDS,
                 created_at: str = "created_at") -> DataFrame:
    """Keep iff ``as_of - created_at < ttl`` (strict)."""
    now = as_of if hasattr(as_of, "alias") else F.lit(as_of).cast(dict(entries.dtypes)[created_at])
    age_us = F.timestamp_diff("MICROSECOND", F.col(created_at), now)
    return entries.where(age_us < F.lit(int(ttl_s * 1_000_000)))


def enforce_capacity(entries: DataFrame, max_size: int = L.CACHE_MAX_SIZE, shard: str | None = "shard",
                     created_at: str = "created_at", e_id: str = "entry_id") -> DataFrame:
    """Keep the newest ``max_size`` entries per shard (FIFO by created_at).

    Per shard it is a ``row_number`` partitioned by shard (WindowGroupLimit trims
    each partition before the shuffle), never one global window. Without shards
    it is an ordered limit (TakeOrderedAndProject: per-partition top-n, then merge).
    """
    order = [F.col(created_at).desc(), F.col(e_id).desc()]
    if not shard:
        return entries.orderBy(*order).limit(max_size)
    w = Window.partitionBy(shard).orderBy(*order)
    return entries.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_size).drop("__rn")


def apply_hits(entries: DataFrame, lookups: DataFrame, e_id: str = "entry_id") -> DataFrame:
    """C1 side effect: ``hits += number of hits`` per entry (aggregate, then join back)."""
    h = lookups.where(F.col("hit")).groupBy(e_id).agg(F.count(F.lit(1)).alias("__h"))
    return entries.join(h, e_id, "left").withColumn(
        "hits", (F.coalesce(F.col("hits"), F.lit(0)) + F.coalesce(F.col("__h"), F.lit(0))).cast("int")).drop("__h")


def stats(entries: DataFrame, ttl_s: float = L.CACHE_TTL_SECONDS, threshold: float = L.CACHE_THRESHOLD) -> DataFrame:
    """C4: live entry count, total hits, ttl, threshold."""
    return entries.agg(F.count(F.lit(1)).alias("entries"),
                       F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits")) \
        .withColumn("ttl_seconds", F.lit(int(ttl_s))).withColumn("threshold", F.lit(float(threshold)))


def invalidate(entries: DataFrame, current_version: int, version: str = "index_version") -> DataFrame:
    """Entries written against an older index version are dropped."""
    return entries.where(F.col(version) >= F.lit(current_version))


def near_duplicates(queries: DataFrame, *, q_id: str = "query_id", q_vec: str = "vec", q_time: str = "ts",
                    ttl_s: float = L.CACHE_TTL_SECONDS, threshold: float = L.CACHE_THRESHOLD,
                    method: str = "block", **kw) -> DataFrame:
    """Share of queries with an earlier one (within TTL) at cosine >= threshold.

    ``method="block"`` compares all pairs of a TTL bucket exactly. ``method="lsh"`` (needs ``dim``)
    compares only bucket mates of the signed projections within the TTL buckets: for large logs;
    its share is a lower bound, its scores are exact.
    """
    earlier = queries.select(F.col(q_id).alias("__earlier"), F.col(q_vec).alias("__ev"), F.col(q_time).alias("__et"))
    qk, ek = _ttl_buckets(queries.select(q_id, q_vec, q_time), q_time, earlier, "__et", ttl_s)
    search = {"block": block_topk, "lsh": approx_topk}[method]
    best = search(qk, ek, 1, q_id=q_id, i_id="__earlier", q_key="__tb", i_key="__tb", q_vec=q_vec,
                  i_vec="__ev", q_time=q_time, i_time="__et", max_age_s=ttl_s, tie="__et", **kw)
    dup = best.where(F.col("score") >= threshold).select(q_id).withColumn("__d", F.lit(1))
    j = queries.select(q_id).join(dup, q_id, "left")
    return j.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("__d"), F.lit(0)).cast("long")
                 .alias("near_duplicates")).withColumn(
        "share", F.when(F.col("queries") > 0, F.round(F.col("near_duplicates") / F.col("queries"), 6)))



"""Role-based access as columns, semi-joins and a theta join.

The role dimension is a fixed six-row table, so lookups are CASE expressions
(no join at all) and joins against it are broadcast with a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import norm_role


def allowed_namespaces(role: Column | str) -> Column:
    """Namespaces of a role after lower/strip; unknown -> ['general']."""
    r = norm_role(role)
    chain = None
    for name, nss in L.ROLE_NAMESPACES:
        arr = F.array(*[F.lit(n) for n in nss])
        chain = F.when(r == name, arr) if chain is None else chain.when(r == name, arr)
    return chain.otherwise(F.array(*[F.lit(n) for n in L.DEFAULT_NAMESPACES]))


def role_level(role: Column | str) -> Column:
    """Privilege level; unknown -> 0."""
    r = norm_role(role)
    chain = None
    for name, lvl in L.ROLE_LEVELS:
        chain = F.when(r == name, F.lit(lvl)) if chain is None else chain.when(r == name, F.lit(lvl))
    return chain.otherwise(F.lit(L.UNKNOWN_ROLE_LEVEL))


def can_access(user_role: Column | str, required_role: Column | str) -> Column:
    """level(user) >= level(required); two unknown roles compare true."""
    return role_level(user_role) >= role_level(required_role)


def is_valid_role(role: Column | str) -> Column:
    """R5."""
    return norm_role(role).isin(*[r for r, _ in L.ROLE_LEVELS])


def is_unrestricted(role: Column | str) -> Column:
    return norm_role(role) == L.UNRESTRICTED_ROLE


def namespace_filter(chunks: DataFrame, role: str, namespace: str = "namespace") -> DataFrame:
    """R2 for one fixed role: a plain ``isin`` on the namespace column.

    When chunks are stored partitioned by namespace this prunes partitions at scan.
    The unrestricted role gets no filter at all.
    """
    r = role.lower().strip()
    if r == L.UNRESTRICTED_ROLE:
        return chunks
    allowed = dict(L.ROLE_NAMESPACES).get(r, L.DEFAULT_NAMESPACES)
    return chunks.where(F.col(namespace).isin(*allowed))


def principal_namespaces(principals: DataFrame, chunks: DataFrame, role: str = "role",
                         namespace: str = "namespace") -> DataFrame:
    """R1/R2 as rows: one (principal…, namespace) per namespace the principal may read.

    The unrestricted role gets one row per *distinct namespace present in chunks*
    (also namespaces no role lists), so no OR enters the later join condition.
    The distinct-namespace set is a partial aggregate of the chunk table, tiny.
    """
    restricted = principals.where(~is_unrestricted(role)).withColumn(
        namespace, F.explode(allowed_namespaces(role)))
    # The unrestricted role expands to the distinct namespaces present in the chunk
    # table, read as one array-valued scalar subquery (a partial collect_set, as
    # many elements as there are namespaces) — an explode, not a join.
    present = chunks.agg(F.array_sort(F.collect_set(namespace))).scalar()
    unrestricted = principals.where(is_unrestricted(role)).withColumn(namespace, F.explode(present))
    return restricted.unionByName(unrestricted)


def role_class(role: Column | str) -> Column:
    """The known role's name, or 'unknown' for any other: at most one value more than there are roles."""
    return F.when(is_valid_role(role), norm_role(role)).otherwise(F.lit(L.UNKNOWN_ROLE))


def visible_rows(principals: DataFrame, chunks: DataFrame, role: str = "role",
                 namespace: str = "namespace", bounded: bool = False) -> DataFrame:
    """R2 for many principals: equi-join chunks to the principals' namespaces.

    ``bounded``: the principals are role classes (:func:`role_class`), so that there are at most
    roles x namespaces pairs; these are broadcast and the chunk table is never shuffled on its few
    namespaces. Leave it off for user tables, whose size has no bound.
    """
    pairs = principal_namespaces(principals, chunks, role, namespace)
    return (F.broadcast(pairs) if bounded else pairs).join(chunks, namespace, "inner")


def invalid_roles(df: DataFrame, role: str = "role") -> DataFrame:
    """R5 report: rows whose role is not a known role."""
    return df.where(~is_valid_role(role))


def accessible_counts(principal_roles: DataFrame, owned: DataFrame, role: str = "role",
                      owner_role: str = "owner_role") -> DataFrame:
    """R4 as a theta join at scale: how many owned rows each role may read by hierarchy.

    The owned table is first reduced to a histogram by owner level (a partial
    aggregate; its size is the number of distinct levels), then the theta
    condition ``level(user) >= level(owner)`` joins two tiny tables.
    """
    hist = owned.groupBy(role_level(owner_role).alias("owner_level")).agg(F.count(F.lit(1)).alias("n"))
    roles = principal_roles.select(F.col(role).alias("role"), role_level(role).alias("level"))
    return (roles.join(F.broadcast(hist), F.col("level") >= F.col("owner_level"), "left")
            .groupBy("role").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("accessible")))

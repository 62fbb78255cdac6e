"""Shared string helpers with Python ``str`` semantics, built from JVM functions.

``(?U)`` turns on Unicode character classes and case folding in Java regex, which
is what Python's ``re`` does for ``str`` patterns by default.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"


def memo_column(fn):
    """Cache a pure Column builder called with a column *name* and hashable options.

    Building long CASE chains costs hundreds of Py4J round trips; the resulting
    (unresolved) expression does not depend on any DataFrame, so it is built once
    per JVM and reused. Calls with Column arguments are not cached.
    """
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        try:
            from pyspark import SparkContext
            gw = id(SparkContext._gateway)
            key = (gw, args, tuple(sorted(kwargs.items())))
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        if any(isinstance(a, Column) for a in list(args) + list(kwargs.values())):
            return fn(*args, **kwargs)
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]

    return wrapper


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_regex(pattern: str, unicode: bool = True) -> str:
    """A library pattern as Java sees it with Python's Unicode classes."""
    return (UNICODE + pattern) if unicode else pattern


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``)."""
    return F.regexp_count(col_of(text), F.lit(UNICODE + r"\S+")).cast("int")


def strip(text: Column | str) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(col_of(text), UNICODE + r"^\s+|\s+$", "")


def norm_role(role: Column | str) -> Column:
    """``role.lower().strip()``."""
    return strip(F.lower(col_of(role)))


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased whitespace tokens, punctuation kept (``set(s.lower().split())``)."""
    toks = F.split(F.lower(col_of(text)), UNICODE + r"\s+")
    return F.array_distinct(F.filter(toks, lambda x: x != F.lit("")))


def hashed_token_set(text: Column | str) -> Column:
    """:func:`token_set` as 64-bit hashes: smaller to move and to compare, for set sizes and overlaps only."""
    return F.array_distinct(F.transform(token_set(text), lambda x: F.xxhash64(x)))


def sha256_prefix(text: Column | str, n: int) -> Column:
    """First ``n`` hex characters of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(col_of(text), 256), 1, n)


EPOCH = "1970-01-01 00:00:00"


def epoch_us(df, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column, independent of the session zone.

    TIMESTAMP_NTZ is measured from the NTZ epoch (no zone involved); TIMESTAMP is an
    instant already. Casting NTZ to TIMESTAMP would apply the session zone and shift
    differences across DST changes.
    """
    if dict(df.dtypes).get(name) == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def ntz_from_epoch_us(us: Column) -> Column:
    """Inverse of :func:`epoch_us` for TIMESTAMP_NTZ results."""
    return F.timestamp_add("MICROSECOND", us, F.lit(EPOCH).cast("timestamp_ntz"))

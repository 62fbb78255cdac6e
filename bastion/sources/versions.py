"""Tables that are published together, under one version.

``publish`` writes every table of a set below ``root/v=<n>`` and then creates one marker file
``root/_published/<n>``. Creating that file is the only step readers see, so a failure between two writes leaves the set
before it as it was, and two writers that take the same number cannot both win. Readers ask for
the current version once and pin it; the cache takes its number from it and drops entries of older ones (C5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    return sorted(int(n) for n in _names(spark, f"{root}/_published") if n.isdigit())


def current_version(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
    """Write all ``tables`` under a new version and switch readers to it last; returns the version.

    The tables may read the version before: nothing of it is touched. What a failed run left under its number is
    overwritten by none: the next run takes a higher one.
    """
    taken = [int(n[2:]) for n in _names(spark, root) if n.startswith("v=") and n[2:].isdigit()]
    version = max([0, *taken, *versions(spark, root)]) + 1
    for name, df in tables.items():
        columns = (partition_by or {}).get(name, [])
        df.write.mode("error").partitionBy(*columns).parquet(f"{root}/v={version}/{name}")
    fs, marker = _fs(spark, f"{root}/_published/{version}")
    fs.create(marker, False).close()  # fails if another writer has published this number
    return version


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a published version (default: the current one). Pin the version to read several tables of one set."""
    version = version if version is not None else current_version(spark, root)
    if version not in versions(spark, root):
        raise FileNotFoundError(f"no published version {version} below {root}")
    return spark.read.option("basePath", f"{root}/v={version}/{table}").parquet(f"{root}/v={version}/{table}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Unpublish and delete all but the newest ``keep`` versions; returns those that went."""
    old = versions(spark, root)[:-keep] if keep else versions(spark, root)
    for version in old:
        for path in (f"{root}/_published/{version}", f"{root}/v={version}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return old

"""Session helpers.

Library code never creates its own session; callers pass one in. ``local_session``
exists for tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bastion") -> SparkSession:
    """A local session tuned for tests: UTC, AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is used as is.
    Only a ``local[...]`` session without it (tests) gets a scratch folder of its own.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="bastion-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut lineage at a fan-out point: write ``df`` as Parquet below the shared checkpoint folder, read it back.

    The input is computed once (a reliable ``checkpoint()`` computes it twice: once for the action and once
    for the files), stays columnar and compressed, and survives a lost executor. The files live below
    ``bastion/<application id>``; :func:`drop_materialized` deletes them when the results are written.
    """
    import uuid

    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stage_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bastion/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; :func:`drop_materialized` deletes it."""
    import uuid

    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_materialized(spark: SparkSession) -> None:
    """Delete all that :func:`materialize` wrote in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``bastion`` importable in Python workers (pandas kernels refer to it).

    Zips the package once per application and registers it with ``addPyFile``;
    Spark copies it to every executor. On a cluster, ``--py-files`` does the same.
    """
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="bastion-pkg-")
    zip_path = shutil.make_archive(os.path.join(out, "bastion"), "zip", os.path.dirname(pkg_dir), "bastion")
    sc.addPyFile(zip_path)
    _SHIPPED.add(app)


# Settings the operators assume on a large cluster (set them at submit time).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                       # runtime re-planning, coalescing
    "spark.sql.adaptive.skewJoin.enabled": "true",              # split hot join partitions
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",  # target post-shuffle partition size
    "spark.sql.files.maxPartitionBytes": "256m",                # scan split size (text-heavy tables)
    "spark.sql.shuffle.partitions": "8000",                     # upper bound; AQE coalesces down
    "spark.sql.autoBroadcastJoinThreshold": "64m",              # dimension tables only
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",    # pandas kernel batch size
    "spark.sql.session.timeZone": "UTC",
}

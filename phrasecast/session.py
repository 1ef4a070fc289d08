"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T


def build_session(
    app: str = "phrasecast", master: str | None = None, cpus: int | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the library relies on (UTC clock, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if cpus:
        builder = builder.config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local master gets a fresh temporary folder; on a cluster that is an error,
    because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="phrasecast-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/phrasecast/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of an execution are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = threading.Lock(), 0, "false"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it ends; the setting of before comes back after the last of several threads."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(_CLEANUP, _before)


def materialize(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, so a lost executor never recomputes (and never renumbers) it.
    ``schema`` may re-type columns that are stored alike, such as a struct read back as a vector. The
    table is all that stays on disk: its shuffle files go when it is written, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_deleted(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote under the shared folder; its frames cannot be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/phrasecast/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer files than cores; large inputs are left as they are.

    A single Parquet row group is one task, whatever its size, and text work is all CPU.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

"""Session helpers: building a session for tests/bench and locating shared scratch space."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tidepool") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitter's configuration wins."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Parts into which rows are dealt before a grouping that holds nearly all of them; with few tasks, each would hold a large share of the input.
FINE_PARTS = 200


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only with a ``local`` master (tests), where one machine is all there is, may it
    be unset: a private folder under the system temp dir is then registered in its place.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        # spark.checkpoint.dir cannot be set in a running session: the context keeps the folder
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidepool-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, never-reused sub-folder of the shared checkpoint folder, kept with the others of this application."""
    return f"{_scratch(spark)}/{kind}-{uuid.uuid4().hex[:12]}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidepool/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables and streams that this application has written to the shared folder.

    Queries read them until their results are written, so a caller calls this once it has all it wants.
    """
    if path_exists(spark, _scratch(spark)):
        drop_path(spark, _scratch(spark))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as each query ends, not when the driver happens to collect its garbage: for long jobs of several
    queries. A table that is read again later would be shuffled again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making, with what is in it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)

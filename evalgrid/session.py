"""Session helpers: a tuned SparkSession for tests/bench and a shared scratch folder.

Scratch output (round-trip sinks, lineage cuts) goes under the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that is unset -- local tests -- do we
pick a folder of our own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "evalgrid", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UI off, UTC time zone.

    Under ``spark-submit`` the master, the sizes and the number of shuffle partitions are the cluster's;
    they are only set here for a local session.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast only on *measured* sizes: static estimates ignore explode fan-outs, so the
        # planner could pick a fact table; AQE converts to a broadcast join from shuffle statistics
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        # rows here are small but CPU-heavy (regex parsing, Arrow UDFs): do not let AQE coalesce
        # post-shuffle stages below ~64 KB per partition, or they run on a couple of cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master or not submitted():
        builder = (
            builder.master(master or f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 4))
            .config("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(int(cpus) * 2))
            .config("spark.driver.memory", os.environ.get("EVALGRID_DRIVER_MEMORY", "8g"))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def submitted() -> bool:
    """Whether spark-submit started this process (it hands Python the port of its JVM)."""
    return "PYSPARK_GATEWAY_PORT" in os.environ


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``evalgrid`` importable in the Python workers of every executor (once per context).

    Arrow UDFs are pickled by reference to this package, so executors need it on their path.
    On a cluster, submit it with ``--py-files`` (then nothing happens here); otherwise the
    package is zipped on the driver and served to executors with ``addPyFile``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if "evalgrid" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)  # submitted with --py-files: executors already have it
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="evalgrid-pkg-"), "evalgrid.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  A local session without one gets a temporary folder; on a cluster
    executors would each write to their own disk, so there it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()  # set from spark.checkpoint.dir at start-up, or earlier here
    if current:
        return current
    sc.setCheckpointDir(checkpoint_folder(sc.getConf().get(_CKPT_KEY, None), sc.master))
    return sc.getCheckpointDir()


def checkpoint_folder(configured: str | None, master: str) -> str:
    if configured:
        return configured
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="evalgrid-ckpt-")
    raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evalgrid-scratch/{name}-{uuid.uuid4().hex}"


_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written in this block leaves no shuffle files: each job's go when it has ended.  Without it they stay on the executors' disks
    until the driver happens to collect its garbage, which a driver of few objects does seldom, however much they hold."""
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: what follows sees the same rows however often it runs, and a
    lost executor costs a re-read.  The shuffle files of the write are dropped with its end."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

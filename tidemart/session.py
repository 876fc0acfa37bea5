"""Session construction and shared-storage helpers.

On a cluster the session is handed to us already configured; these helpers
only fill in settings that are missing, so tests and local runs behave like
the cluster (UTC session clock, AQE on, Arrow on, no web UI).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tidemart",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session; on a cluster call with ``master=None`` so the
    launcher's master and settings win."""
    b = SparkSession.builder.appName(app)
    conf = dict(DEFAULTS)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the executor; 1g default is too small
            conf["spark.driver.memory"] = os.environ.get("TIDEMART_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster sets it; only when it is unset (local runs, tests) do we
    create a scratch folder and register it."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidemart-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.replace("file:", "") if d.startswith("file:/") and not d.startswith("file://") else d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


_CLEANUP, _cleanup_lock = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()


def write_and_clean(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; the shuffle files behind it go at once, not
    when the driver happens to collect its garbage. One such write at a time
    holds the setting, so that it is put back as it was."""
    conf = df.sparkSession.conf
    with _cleanup_lock:
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder: made once, for a plan that
    reads it several times."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    write_and_clean(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

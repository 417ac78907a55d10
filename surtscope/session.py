"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Temporary folders of local sessions, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "surtscope", cpus: int | None = None) -> SparkSession:
    """A session with the settings the reports are tuned for.

    On a cluster the master, memory and shared folder come from spark-submit;
    ``cpus`` asks for a local session instead.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # HotSpot leaves methods above 8000 bytecodes uncompiled; wide
        # projections run about twice as fast when split instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
    else:
        # many small shuffle partitions to start with; AQE merges them by size
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8192"
        ).config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its machine.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="surtscope-")
    try:
        spark.conf.set(_CHECKPOINT_KEY, _LOCAL_FOLDERS[app])
    except PySparkException:
        pass  # Spark 4.1 takes this setting at the start of a session only
    return _LOCAL_FOLDERS[app]


def run_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/surtscope/{app}/{label}-{uuid.uuid4().hex[:12]}"

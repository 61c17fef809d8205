"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Finding the Python line of every column expression slows plan building several times.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Lists here are short (event logs, order lines), so hash many keys before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    # Receipt state has no time bound, so it must be able to leave the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "reachline", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with the settings above; master and sizing come from the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="reachline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_WORK_PATHS: list[str] = []


def new_work_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, for one run's tables."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WORK_PATHS.append(path)
    return path


def remove_work_paths(spark: SparkSession) -> None:
    """Deletes the folders that ``new_work_path`` gave out in this process.

    Results are read lazily, so call it once they are written or no longer wanted.
    """
    context = spark.sparkContext
    while _WORK_PATHS:
        path = context._jvm.org.apache.hadoop.fs.Path(_WORK_PATHS.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

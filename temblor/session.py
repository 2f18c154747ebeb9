"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # INT96, the default, carries no statistics, so row groups could not be skipped by time.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Call sites of every Column call, for error texts only, take most of the planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = RECOMMENDED_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must reach it. Only a local master gets a folder of its own when the
    setting is missing; a cluster without one is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    # A folder of this process alone goes with it.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is not created here."""
    path = f"{shared_folder(spark)}/temblor/{label}-{uuid.uuid4().hex}"
    _WORK_FOLDERS.append(path)
    return path


_WORK_FOLDERS: list[str] = []


def remove_work_folders(spark: SparkSession) -> int:
    """Delete the work folders that this process has handed out; results read from them end here."""
    removed = 0
    while _WORK_FOLDERS:
        removed += remove_path(spark, _WORK_FOLDERS.pop())
    return removed


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark reaches; false if there is none."""
    system, where = _file_system(spark, path)
    return system.delete(where, True)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern with ``*``, one listing of folders and no file opened."""
    system, where = _file_system(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in system.globStatus(where) or [])


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.mkdirs(where)


def settle(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which survives lost executors."""
    context = frame.sparkSession.sparkContext
    folder = shared_folder(frame.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return frame.checkpoint()

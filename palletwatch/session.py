"""Session settings and the shared folder that checkpoints and streams write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Static and runtime settings for sessions this package creates itself. On a
# cluster the submitted session usually sets its own; nothing below is required.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}

# State lives in RocksDB so that it may outgrow executor heap; counting its rows
# would cost a lookup per write. Sessions of one key are merged on the map side
# before they are shuffled.
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "palletwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, with its settings and those the streaming operators rely on.

    The caller's session is left as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in (STREAMING | {"spark.sql.session.timeZone": "UTC"}).items():
        own.conf.set(key, value)
    return own


def _is_local_file(folder: str, default_fs: str) -> bool:
    scheme = folder.split(":", 1)[0] if ":/" in folder else default_fs.split(":", 1)[0]
    return scheme == "file"


def _check_reached(spark: SparkSession, folder: str) -> None:
    """An error unless the driver finds what tasks write in ``folder``, and tasks what others wrote there.

    Twice as many tasks as cores, so that every executor there is at the time gets some.
    """
    place = f"{folder}/reached-{uuid.uuid4().hex}"
    try:
        tasks = 2 * spark.sparkContext.defaultParallelism
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(place)
            found = spark.read.schema("id bigint").parquet(place).count()
        finally:
            remove_dir(spark, place)
        if found != tasks:
            raise FileNotFoundError(f"{found} of {tasks} files found")
    except Exception as error:  # whatever fails here would fail with the rows of a query
        raise ValueError(f"spark.checkpoint.dir names a folder of the local file system, {folder}, which not all executors share") from error


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Without one it is a temporary folder if tasks run in the driver's process (a ``local`` master), else one
    of the warehouse, which executors share as well; a temporary one would be lost with its executor.
    On a cluster a folder of the local file system may be a mount that is on every
    machine: a small job tries it each time, unless ``spark.palletwatch.mountedFolder`` is ``true``,
    and a folder that not all executors share is refused.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="palletwatch-")
        elif warehouse:
            folder = f"{warehouse}/palletwatch-checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if not local and spark.conf.get("spark.palletwatch.mountedFolder", "false") != "true":
        if _is_local_file(folder, context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")):
            _check_reached(spark, folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Deletes a folder this package wrote, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"

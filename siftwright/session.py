"""What a session needs to run the engine's Python code on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, so that workers need not have it installed.

    The driver serves the archive (some 100 kB of source) as Spark does with any added file.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siftwright-")
    archive = os.path.join(folder, "siftwright-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(base, n), os.path.relpath(os.path.join(base, n), os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session is local, as in tests, is one made; on a cluster a machine's own folder would not do.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftwright-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that one query writes and reads again; ``clear`` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes the tables of queries whose results are no longer needed."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read from there, so that what follows uses it more than once without making it again.

    Where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, Spark removes it when the frame is no longer used.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt out to all of them; any other frame as it is.

    Worth it before much work a row on tables of few row groups.  Tables with more partitions than cores are never shuffled.
    """
    if "Exchange" in frame._jdf.queryExecution().sparkPlan().toString():
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame

"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a table's (compressed) files for which a shuffle begins with one more partition.
PARTITION_BYTES = 2_000_000
_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_shipped: set[str] = set()
_folders: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once for each application, and keep their batches small.

    Needed only by stages that run Python on the executors.  Texts are long, so
    batches of Spark's default row count would take much of a worker's memory;
    a session that sets its own count keeps it.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / here.name), "zip", here.parent, here.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def spread(spark: SparkSession, path: str, most: int = PARTITION_BYTES) -> None:
    """Let shuffles begin with a partition for each ``most`` bytes of a table, so that a task's share doesn't grow with it.

    Adaptive execution puts small ones together again; a session that begins with more keeps that.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    n = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength() // most
    if n > max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_FIRST_PARTITIONS, None) or 0)):
        spark.conf.set(_FIRST_PARTITIONS, str(n))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's; on a local master that names none, one of our own.

    A cluster without ``spark.checkpoint.dir`` is an error, since a folder of
    this machine isn't seen by its executors.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="boxwright-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one for what a run writes and reads again; ``drop_run_folders`` deletes it."""
    folder = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


def drop_run_folders(spark: SparkSession) -> int:
    """Delete the folders that this process' runs made, and say how many were there. Results that read them must be done with."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n

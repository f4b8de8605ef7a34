"""Where the engine keeps what it writes for itself: a folder that all executors share."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; one in the warehouse only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def stamp(spark: SparkSession, frame: DataFrame) -> str:
    """A digest of the files that a frame reads, with their lengths and times."""
    parts = []
    for name in sorted(frame.inputFiles()):
        fs, path = _folder(spark, name)
        status = fs.getFileStatus(path)
        parts.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def kept_until_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def spread(frame: DataFrame) -> DataFrame:
    """frame, a table as read, dealt out anew if its files give fewer partitions than twice the cores: work on texts is long."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(2 * cores) if frame.rdd.getNumPartitions() < 2 * cores else frame


def checkpointed(frame: DataFrame) -> DataFrame:
    """frame, written to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()

"""Session helpers: the package on the Python workers' path, and a session for local use."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


BATCH_ROWS = "2500"


def ship(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers that later functions start, and bound what they are given at once.

    A batch is counted in rows; at Spark's default of 10,000 a batch of documents takes
    tens of MB on both sides. A setting other than the default stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and bench runs on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("readloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="readloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset there is a temporary one, but only if all tasks run in this
    process: on a cluster each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/readloom/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage: later reads need none of the executors that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete the files of a stash() that nothing reads any more.

    The folder may be on any file system that Spark knows, so Spark's own file API deletes.
    """
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession, label: str | None = None, older_than: float = 24 * 3600) -> int:
    """Delete the tables in the shared folder that were written more than `older_than` seconds ago, those of one label or all; how many went.

    Results are read lazily, so no operator can tell when its tables are done with: call
    this when the results of that time have been written.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/readloom")
    system, n = folder.getFileSystem(conf), 0
    if not system.exists(folder):
        return 0
    for status in system.listStatus(folder):
        path = status.getPath()
        if (label is None or path.getName().rpartition("-")[0] == label) and status.getModificationTime() <= 1000 * (time.time() - older_than):
            n += bool(system.delete(path, True))
    return n

"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []

#: Rows that are worth a task of their own, and rows of a task at most, in work that reads a frame again and again.
TASK_ROWS = 10_000
MOST_TASK_ROWS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Instants are handled in UTC; adaptive execution re-plans joins and splits skewed ones."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder, removed when it ends; on a
    cluster, whose machines do not share one, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="punctual-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/punctual/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_staged(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders that ``shared_folder`` has given out, from the number ``since`` on.

    For the end of a run, when no frame that reads them is used any more.
    """
    jvm = spark.sparkContext._jvm
    while len(_made) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged_so_far() -> int:
    return len(_made)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage of frames that several jobs read; survives lost executors, and the
    copy stays columnar, so later reads are pruned.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A frame of so many rows dealt out evenly, for work that reads it again and again.

    The partitions of a frame follow its bytes, so a narrow one often sits in a single file and a single
    task; iterative training then uses one core.  Here there is a partition for each full TASK_ROWS rows up to
    the cores at hand, and more only where one would hold over MOST_TASK_ROWS: what training merges between its
    passes grows with the number of partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(rows // TASK_ROWS, cores), math.ceil(rows / MOST_TASK_ROWS))
    return df.repartition(parts) if parts > 1 else df

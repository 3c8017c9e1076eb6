"""Shared scratch storage: where operators cut their lineage.

Tables are written below ``spark.checkpoint.dir``, the one folder that the driver and all executors
share, so a lost executor never takes the only copy of an intermediate result with it.  Only where
that setting is absent and the master is local (tests, notebooks) a temporary folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; made and set by us only in local mode, where nobody configured one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="grapnel-"))
        current = context.getCheckpointDir()
    return current


#: Rows of a small table that share a file, and rows up to which a table is small.
FILE_ROWS, SMALL_ROWS = 50_000, 1_000_000


def materialize(frame: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Write ``frame`` as Parquet into the shared folder and return a reader of what was written.

    ``at_most`` is a bound on the rows, where one is known.  A small table is dealt to as many files as its rows
    need and not to one a shuffle partition: on a local file system Hadoop starts processes (chmod) for each file
    and each task's folder, and until such a process has its own program it shows the executor's memory once more.

    The folder is deleted by :func:`discard`, or when the driver's JVM ends (Hadoop's delete-on-exit), on any file system.
    """
    spark = frame.sparkSession
    target = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if at_most is not None and at_most <= SMALL_ROWS:
        # after the work, not coalesced into it: what makes the rows keeps its tasks
        frame = frame.repartition(max(1, -(-at_most // FILE_ROWS)))
    frame.write.mode("error").parquet(target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(conf).deleteOnExit(path)
    table = spark.read.schema(frame.schema).parquet(target)
    table.scratch_path = target
    return table


def discard(table: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once its last reader has been written itself.

    Whatever was made from it must be stored by then: a lost executor's work is done again from stored tables.
    """
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

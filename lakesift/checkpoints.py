"""Results that are cut off from what made them, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows to a task and its file where the number of rows is known beforehand.
ROWS_A_TASK = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it's unset the context's folder.

    A session on one machine gets a temporary one if it has neither; on a cluster that's an error, as executors
    can't see the driver's folders.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lakesift-")


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, whose last stage (not those before its last shuffle) has a task for each core, or more if about so many rows need them."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, written once and read from there.

    Each task writes a file, even without rows, and on file:// without Hadoop's native library its JVM starts two
    processes (chmod) for that. rows: about how many there are, so that few rows go to few files.
    """
    sc = df.sparkSession.sparkContext
    if rows is not None:
        df = in_few_tasks(df, rows)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

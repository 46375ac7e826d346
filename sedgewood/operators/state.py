"""Reliable checkpoints and tables for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets where a table is dealt by its size.
TASK_ROWS = 250_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and the session local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def tasks(rows: int) -> int:
    """The number of tasks to deal so many rows to: what one of them holds does not follow the size of the table."""
    return max(1, -(-rows // TASK_ROWS))


def deal(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df dealt by columns to so many tasks, which Spark does not put together again; to as many as it likes where none are given."""
    return df.repartition(parts, *by) if parts else df.repartition(*by)


def settle(df: DataFrame) -> DataFrame:
    """df checkpointed, so that what follows survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the checkpoint folder and read again.

    Unlike a checkpoint it hands on no partitioning, whose equivalent forms multiply from round to round of a loop of joins
    and make planning ever slower, and its size is known to the optimizer.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

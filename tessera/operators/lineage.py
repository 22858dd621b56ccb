"""Tables that are written in the shared folder: what loops build on, and files that queries read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """A temporary folder of this process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="spark-tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; in a temporary one where that is unset and
    all runs in one process, as executors of a cluster could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/tessera-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` and reads it again, so that the lineage of a loop stays short and a lost executor costs one step."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that :func:`dealt` gives to a task, more or less.
TASK_ROWS = 2_000_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` with equal keys in one task and about :data:`TASK_ROWS` rows in each, however well they compress; sums by these
    keys need no further shuffle. ``rows``, or else a count of ``df``, says how many tasks that takes; few rows stay as they are."""
    tasks = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else df

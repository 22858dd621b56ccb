"""Lines of text files with their numbers, whatever splits they are read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """file, number (from 1), value of every line of a file or a folder of files, compressed or not. Numbers run in each file,
    or with ``across`` on over the files in the order of their names.

    A split knows where in its file it starts, so its lines follow those of the splits before; the table of splits is small."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("first"))
    order = Window.orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")
    before = splits.select("file", "start", "first", (F.sum("lines").over(order) - F.col("lines")).alias("before"))
    return lines.join(F.broadcast(before), ["file", "start"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("number"), "value")

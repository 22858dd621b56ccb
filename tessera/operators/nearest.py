"""Nearest rows of a set of queries among all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block; every block of queries meets every block of rows in one task.
QUERIES, ROWS = 2048, 50_000


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _nearest_of_block(k: int, digits: int):
    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            x, vectors = rows.column("x").to_numpy(), _vectors(rows.column("vector"))
            for q, own in zip(queries.column("q").to_pylist(), _vectors(queries.column("vector"))):
                d = np.round(np.sqrt(((vectors - own) ** 2).sum(axis=1)), digits)
                some = np.flatnonzero(x != q)
                if len(some) > k:
                    some = some[d[some] <= np.partition(d[some], k - 1)[k - 1]]
                some = some[np.lexsort((x[some], d[some]))[:k]]
                out.append((np.full(len(some), q), x[some], d[some]))
        cat = lambda i, kind: pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0), kind)
        return pa.table([cat(0, pa.int64()), cat(1, pa.int64()), cat(2, pa.float64())], names=["q", "x", "d"])

    return meet


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 5, query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """q, x, d, k: the ``k`` rows (x, vector) at the smallest Euclidean distance from each query (q, vector), itself left out;
    equal distances by id. A block of queries keeps k rows of every block of rows, and those are ordered at the end."""
    parts = lambda df, size: max(1, -(-df.count() // size))
    blocks, places = parts(queries, query_block), parts(rows, row_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("x", "vector", F.pmod(F.xxhash64("x"), F.lit(places)).cast("int").alias("place"), every(blocks).alias("block"))
    right = queries.select("q", "vector", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), every(places).alias("place"))
    met = left.groupBy("block", "place").cogroup(right.groupBy("block", "place")).applyInArrow(_nearest_of_block(k, digits), "q long, x long, d double")
    return met.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "x"))).where(F.col("k") <= k)

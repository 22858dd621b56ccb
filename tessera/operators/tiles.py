"""Two fields held against each other at every shift, in square tiles with a halo.

The points of one side go to the tile that they lie in. The raster of the other goes to its own tile and, within
``radius`` of an edge, to the one to three tiles beyond it, so a field is shuffled about once however many shifts there
are. A task has one tile at a time, at most (side + 2 radius)^2 cells of the raster, moves it by every shift in numpy, and
returns sums that Spark adds up over the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side of a tile at least, and in radii; a larger one has less halo for its size.
LEAST_SIDE, RADII = 64, 8


def tile_side(radius: int) -> int:
    return max(LEAST_SIDE, RADII * radius)


def _tile(at: Column, side: int) -> Column:
    return F.floor(at / side).cast("long")


def with_halo(cells: DataFrame, radius: int, side: int) -> DataFrame:
    """Each cell once for every tile (tr, tc) that it lies in or within ``radius`` of; at most four for sides of two radii."""
    reach = lambda at: F.explode(F.sequence(_tile(F.col(at) - radius, side), _tile(F.col(at) + radius, side)))
    return cells.withColumn("tr", reach("r")).withColumn("tc", reach("c"))


def _codes(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of the integer columns ``names``, and the number of each row among them."""
    if not names or not table.num_rows:
        return np.zeros((min(1, table.num_rows), 0), np.int64), np.zeros(table.num_rows, np.int64)
    found, number = np.unique(np.stack([table.column(k).to_numpy() for k in names], axis=1), axis=0, return_inverse=True)
    return found, number.reshape(-1)


def _sums_of_tile(radius: int, side: int, on_a: Sequence[str], on_b: Sequence[str], sums: dict[str, tuple[int, int]]) -> Callable:
    wide = side + 2 * radius
    names = ["dy", "dx", *on_a, *on_b, "n", *sums]
    kinds = [pa.int64()] * (3 + len(on_a) + len(on_b)) + [pa.float64()] * len(sums)

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        top, left = (int(k.as_py()) * side - radius for k in key)
        groups_a, code_a = _codes(a, on_a)
        groups_b, code_b = _codes(b, on_b)
        cell = (a.column("r").to_numpy() - top) * wide + (a.column("c").to_numpy() - left)
        raster = np.zeros(wide * wide, np.int64)  # 0: no cell of a
        raster[cell] = code_a + 1
        at = (b.column("r").to_numpy() - top) * wide + (b.column("c").to_numpy() - left)
        y = b.column("y").to_numpy() if any(q for _, q in sums.values()) else None
        powers = {}
        for p in sorted({p for p, _ in sums.values()}):
            powers[p] = np.zeros(wide * wide)
            powers[p][cell] = a.column("x").to_numpy() ** p if p else 1.0
        weights = {q: y**q if q else np.ones(len(at)) for q in {q for _, q in sums.values()}}
        nb, cells = len(groups_b), (len(groups_a) + 1) * len(groups_b)
        one = cells == 2
        found = []
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                under = at - (dy * wide + dx)
                met = raster[under]
                if one:
                    n = np.array([0, np.count_nonzero(met)])
                else:
                    code = met * nb + code_b
                    n = np.bincount(code, minlength=cells)
                some = np.flatnonzero(n[nb:]) + nb
                if not len(some):
                    continue
                row = [n[some]]
                for p, q in sums.values():
                    each = powers[p][under]
                    row.append(np.array([each @ weights[q]]) if one else np.bincount(code, each * weights[q], cells)[some])
                found.append(([dy] * len(some), [dx] * len(some), some, *row))
        if not found:
            return work(key, a.slice(0, 0), b)
        dy, dx, code, n, *rest = (np.concatenate(x) for x in zip(*found))
        own = [groups_a[code // nb - 1][:, k] for k in range(len(on_a))] + [groups_b[code % nb][:, k] for k in range(len(on_b))]
        return pa.table([pa.array(np.asarray(x), t) for x, t in zip([dy, dx, *own, n, *rest], kinds)], names=names)

    return work


def met_sums(a: DataFrame, b: DataFrame, radius: int, on_a: Sequence[str] = (), on_b: Sequence[str] = (), **sums: tuple[int, int]) -> DataFrame:
    """dy, dx, the integer columns ``on_a`` and ``on_b``, n and sums over all pairs of a cell of ``a`` at (r, c) and a row of ``b``
    at (r + dy, c + dx), for every shift within ``radius``.

    ``a`` has one row a cell, with x if a sum asks for it; ``b`` any number, with y. A sum (p, q) is that of x^p y^q.
    Shifts and groups without a pair have no row; rows with a null place or group take no part."""
    side = tile_side(radius)
    need = lambda k: any(s[k] for s in sums.values())
    value = lambda name, k: [F.col(name).cast("double").alias(name)] if need(k) else []
    place = [F.col(k).cast("long").alias(k) for k in "rc"]
    integer = lambda names: [F.col(k).cast("long").alias(k) for k in names]
    left = with_halo(a.select(*place, *integer(on_a), *value("x", 0)).dropna(subset=["r", "c", *on_a]), radius, side)
    right = b.select(*place, *integer(on_b), *value("y", 1)).dropna(subset=["r", "c", *on_b]).withColumns({"tr": _tile(F.col("r"), side), "tc": _tile(F.col("c"), side)})
    out = T.StructType([T.StructField(k, T.LongType()) for k in ("dy", "dx", *on_a, *on_b, "n")] + [T.StructField(k, T.DoubleType()) for k in sums])
    tiles = left.groupBy("tr", "tc").cogroup(right.groupBy("tr", "tc")).applyInArrow(_sums_of_tile(radius, side, on_a, on_b, sums), out)
    return tiles.groupBy("dy", "dx", *on_a, *on_b).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))

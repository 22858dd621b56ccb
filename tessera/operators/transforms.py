"""Transforms of whole grids, one axis after the other: exact distances, and correlation at every lag.

Both are separable, so a task has some whole columns, or rows, of the grid and never all of it; the shuffle between turns
columns into rows. A line of the grid must fit into a task's memory, the grid need not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of arrays that the lines of one group may take.
GROUP_BYTES = 32 << 20


def _scan(at: np.ndarray, size: int, where: np.ndarray) -> np.ndarray:
    """The distance along a line of ``size`` places from each place in ``at`` to the nearest in ``where``; -1 without one."""
    if not len(where):
        return np.full(len(at), -1, np.int64)
    where = np.sort(where)
    after = np.searchsorted(where, at)
    up = np.where(after < len(where), where[np.minimum(after, len(where) - 1)] - at, size)
    down = np.where(after > 0, at - where[np.maximum(after - 1, 0)], size)
    return np.minimum(up, down)


def lower_envelope(width: int, at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """min over k of (x - at[k])^2 + height[k] for every x below ``width``; ``at`` ascends and is not empty.

    The parabola that is lowest at a place lies no farther left than the one that is lowest at a place to the left. So the
    places halfway between known ones only try the parabolas between theirs, all places of a level at once."""
    best = np.zeros(width + 2, np.int64)  # of place x at x + 1; the ends hold the first and the last parabola
    best[-1] = len(at) - 1
    out = np.empty(width + 2, np.int64)
    step = 1 << max(0, int(width).bit_length() - 1)
    while step:
        x = np.arange(step, width + 1, 2 * step)
        low, high = best[x - step], best[np.minimum(x + step, width + 1)]
        count = high - low + 1
        begin = np.cumsum(count) - count
        k = np.repeat(low - begin, count) + np.arange(count.sum())
        value = (np.repeat(x - 1, count) - at[k]) ** 2 + height[k]
        least = np.minimum.reduceat(value, begin)
        hits = np.flatnonzero(value == np.repeat(least, count))
        best[x] = k[hits[np.searchsorted(hits, begin)]]
        out[x] = least
        step //= 2
    return out[1:-1]


def squared_distances(cells: DataFrame, flags: Sequence[str]) -> DataFrame:
    """r, c and for each boolean column of ``flags`` a column d2_flag: the squared distance of the cell to the nearest cell
    where the flag holds, at any distance; null where it holds nowhere. ``cells`` has one row a cell, of any shape.

    Scans of every column, then the lower envelope of parabolas of every row: one shuffle an axis."""
    flags = list(flags)

    def columns(key: tuple, group: pa.Table) -> pa.Table:
        r = group.column("r").to_numpy()
        size = int(r.max() - r.min()) + 1
        got = [_scan(r, size, r[group.column(f).fill_null(False).to_numpy()]) for f in flags]
        return pa.table([group.column("r"), group.column("c"), *map(pa.array, got)], names=["r", "c", *flags])

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        c = group.column("c").to_numpy()
        first, width = int(c.min()), int(c.max() - c.min()) + 1
        out = []
        for f in flags:
            g = group.column(f).to_numpy()
            some = np.flatnonzero(g >= 0)
            some = some[np.argsort(c[some])]
            if not len(some):
                out.append(pa.nulls(len(c), pa.int64()))
            else:
                out.append(pa.array(lower_envelope(width, c[some] - first, g[some] ** 2)[c - first]))
        return pa.table([group.column("r"), group.column("c"), *out], names=["r", "c", *(f"d2_{f}" for f in flags)])

    place = [F.col(k).cast("long").alias(k) for k in "rc"]
    scanned = cells.select(*place, *(F.col(f).cast("boolean").alias(f) for f in flags)).groupBy("c").applyInArrow(columns, "r long, c long, " + ", ".join(f"{f} long" for f in flags))
    return scanned.groupBy("r").applyInArrow(rows, "r long, c long, " + ", ".join(f"d2_{f} long" for f in flags))


def _fast_size(n: int) -> int:
    """The least number of at least ``n`` with no prime factor above five."""
    best = 1 << max(0, n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            k = three << max(0, -(-n // three) - 1).bit_length()
            best = min(best, k) if k >= n else best
            three *= 3
        five *= 5
    return best


#: The products of the two sides' maps (presence, value, square) that a correlation needs, by the name of their sum.
_SUMS = {"n": (0, 0), "sx": (1, 0), "sy": (0, 1), "sxx": (2, 0), "syy": (0, 2), "sxy": (1, 1)}


def lag_sums(a: DataFrame, b: DataFrame, height: int, width: int, reach: tuple[int, int] | None = None) -> DataFrame:
    """dy, dx, n, sx, sy, sxx, syy, sxy over all pairs of a cell of ``a`` (r, c, v) and one of ``b`` at (r + dy, c + dx), for
    every lag within ``reach``, by default all at which the grids overlap.

    Fourier transforms of rows and then of columns, padded so that no lag wraps around: each row of both fields becomes the
    spectra of presence, value and square; blocks of columns of these are transformed, multiplied and transformed back to
    lags of rows; each lag of rows then comes back to lags of columns. So the work is that of six transforms of the grid,
    at any reach. Counts are exact; sums have the rounding of the transform. Values are taken about the mean of their
    field, which the sums then undo. Lags without a pair have no row."""
    ry, rx = reach or (height - 1, width - 1)
    tall, wide = _fast_size(height + min(ry, height - 1)), _fast_size(width + min(rx, width - 1))
    half = wide // 2 + 1
    block = max(1, min(half, GROUP_BYTES // (16 * 12 * tall)))  # columns of a group: twelve complex arrays of their height
    blocks = -(-half // block)
    both = a.select(F.lit(0).alias("side"), "r", "c", "v").unionByName(b.select(F.lit(1).alias("side"), "r", "c", "v"))
    both = both.select("side", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v")).dropna()
    mean = {x.side: x.m for x in both.groupBy("side").agg(F.avg("v").alias("m")).collect()}  # two rows

    def spectra(key: tuple, group: pa.Table) -> pa.Table:
        side, r = (k.as_py() for k in key)
        line = np.zeros((3, wide))
        c, v = group.column("c").to_numpy(), group.column("v").to_numpy() - mean[side]
        line[0, c], line[1, c], line[2, c] = 1, v, v * v
        got = np.fft.rfft(line)
        parts = [got[:, k * block : (k + 1) * block].astype(np.complex128).tobytes() for k in range(blocks)]
        return pa.table([pa.array(range(blocks), pa.int32()), pa.array([side] * blocks, pa.int32()), pa.array([r] * blocks, pa.int64()), pa.array(parts, pa.binary())], names=["block", "side", "r", "body"])

    def products(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        n = min(block, half - k * block)
        maps = np.zeros((2, 3, tall, n), np.complex128)
        for side, r, body in zip(*(group.column(x).to_pylist() for x in ("side", "r", "body"))):
            maps[side, :, r] = np.frombuffer(body, np.complex128).reshape(3, n)
        maps = np.fft.fft(maps, axis=2)
        np.conjugate(maps[0], out=maps[0])
        lags = np.arange(-ry, ry + 1)
        got = np.stack([np.fft.ifft(maps[0, i] * maps[1, j], axis=0)[lags % tall] for i, j in _SUMS.values()], axis=1)
        return pa.table([pa.array(lags), pa.array([k] * len(lags), pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())], names=["dy", "block", "body"])

    def lines(key: tuple, group: pa.Table) -> pa.Table:
        spectrum = np.zeros((6, half), np.complex128)
        for k, body in zip(group.column("block").to_pylist(), group.column("body").to_pylist()):
            part = np.frombuffer(body, np.complex128).reshape(6, -1)
            spectrum[:, k * block : k * block + part.shape[1]] = part
        lags = np.arange(-rx, rx + 1)
        n, sx, sy, sxx, syy, sxy = np.fft.irfft(spectrum, wide)[:, lags % wide]
        n = np.rint(n)
        mx, my = mean.get(0, 0.0), mean.get(1, 0.0)
        sums = [n, sx + n * mx, sy + n * my, sxx + 2 * mx * sx + n * mx * mx, syy + 2 * my * sy + n * my * my, sxy + mx * sy + my * sx + n * mx * my, sx, sy, sxx, syy, sxy]
        some = n > 0
        return pa.table([pa.array(np.full(some.sum(), key[0].as_py())), pa.array(lags[some]), pa.array(n[some].astype(np.int64)), *(pa.array(s[some]) for s in sums[1:])], names=["dy", "dx", "n", *list(_SUMS)[1:], *(f"c_{k}" for k in list(_SUMS)[1:])])

    rows = both.groupBy("side", "r").applyInArrow(spectra, "block int, side int, r long, body binary")
    met = rows.groupBy("block").applyInArrow(products, "dy long, block int, body binary")
    return met.groupBy("dy").applyInArrow(lines, "dy long, dx long, n long, " + ", ".join(f"{k} double" for k in (*list(_SUMS)[1:], *(f"c_{k}" for k in list(_SUMS)[1:]))))


def correlation_surface(a: DataFrame, b: DataFrame, height: int, width: int, reach: tuple[int, int] | None = None, least: int = 3) -> DataFrame:
    """dy, dx, n and ncc at every lag within ``reach``: the correlation over joint support; null for fewer than ``least`` cells
    or a side that is constant but for rounding. The transforms round by some 10^-16 of the whole fields' sums of squares, so
    where the cells that meet vary ten thousand times less than the fields, the sixth digit is not certain."""
    s = lag_sums(a, b, height, width, reach)
    n, x, y = F.col("n"), F.col("c_sx"), F.col("c_sy")  # about the means: nothing cancels
    vx, vy = n * F.col("c_sxx") - x * x, n * F.col("c_syy") - y * y
    ok = (n >= least) & (vx > 1e-9 * n * F.col("c_sxx")) & (vy > 1e-9 * n * F.col("c_syy"))
    ncc = F.when(ok, (n * F.col("c_sxy") - x * y) / F.sqrt(F.when(ok, vx * vy).otherwise(1.0)))
    return s.select("dy", "dx", "n", F.round(F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), ncc))), 6).alias("ncc"))

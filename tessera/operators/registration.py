"""Registration of a mask to counts: extremes of shift surfaces, affine fits of regions and the check of a whole slide.

A surface is a table (dy, dx, v); a stack of surfaces has key columns too, and every function works on all of a stack at
once. Offsets are few by definition, so windows and joins inside one surface are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster
from .grid import with_shifts
from .lineage import cut
from .tiles import met_sums

#: Chebyshev distances of the ring that a centre is held against.
RING = (3, 5)


def chebyshev(dy: Column, dx: Column) -> Column:
    return F.greatest(F.abs(dy), F.abs(dx))


def neighbours(stack: DataFrame, keys: list[str]) -> DataFrame:
    """``stack`` with the least, most and median value of the eight offsets around, and how many of them there are."""
    sent = with_shifts(stack.select(*keys, F.col("dy").alias("_y"), F.col("dx").alias("_x"), F.col("v").alias("_v")), 1).where("dy <> 0 or dx <> 0")
    at = sent.groupBy(*keys, (F.col("_y") + F.col("dy")).alias("dy"), (F.col("_x") + F.col("dx")).alias("dx"))
    return stack.join(at.agg(F.min("_v").alias("least"), F.max("_v").alias("most"), F.percentile("_v", F.lit(0.5)).alias("middle"), F.count("_v").alias("around")), [*keys, "dy", "dx"])


def extremes(stack: DataFrame, keys: list[str], search: int) -> DataFrame:
    """Per surface its deepest dip and its highest peak within ``search``, as rows of a ``kind``: an offset below, or above,
    all of its eight neighbours, by its depth under or height over their median; the first in row order of equal ones."""
    near = neighbours(stack, keys).where((F.col("around") == 8) & (chebyshev(F.col("dy"), F.col("dx")) <= search))
    dip, ratio = F.col("v") < F.col("least"), F.try_divide("v", "middle")
    hit = near.where(dip | (F.col("v") > F.col("most"))).withColumn("kind", F.when(dip, "dip").otherwise("peak")).withColumn("size", F.when(dip, 1 - ratio).otherwise(ratio - 1))
    best = hit.groupBy(*keys, "kind").agg(F.min(F.struct((-F.col("size")).alias("low"), "dy", "dx", "v", "middle")).alias("b"))
    every = stack.select(*keys).distinct().withColumn("kind", F.explode(F.array(F.lit("dip"), F.lit("peak"))))
    got = every.join(best, [*keys, "kind"], "left")
    return got.select(*keys, "kind", F.col("b").isNotNull().alias("found"), "b.dy", "b.dx", (-F.col("b.low")).alias("size"), F.col("b.v").alias("value"), F.col("b.middle").alias("neighbour_median"), (chebyshev(F.col("b.dy"), F.col("b.dx")) == search).alias("boundary"))


def depth_at(stack: DataFrame, keys: list[str], dy: int, dx: int) -> DataFrame:
    """One minus the value at an offset over the median of its neighbours; null where one is missing or that is not positive."""
    near = neighbours(stack.where((F.abs(F.col("dy") - dy) <= 1) & (F.abs(F.col("dx") - dx) <= 1)), keys).where((F.col("dy") == dy) & (F.col("dx") == dx))
    depth = F.when((F.col("around") == 8) & (F.col("middle") > 0), 1 - F.try_divide("v", "middle"))
    return stack.select(*keys).distinct().join(near.select(*keys, depth.alias("depth")), keys, "left")


def rings(surface: DataFrame, search: int, reach: int = RING[1]) -> DataFrame:
    """dy, dx, distance and the median of the surface at that Chebyshev distance, for the centres within ``search``."""
    centres = with_shifts(surface.select(F.col("dy").alias("y"), F.col("dx").alias("x"), "v"), reach)
    sent = centres.select((F.col("y") - F.col("dy")).alias("cy"), (F.col("x") - F.col("dx")).alias("cx"), chebyshev(F.col("dy"), F.col("dx")).alias("distance"), "v").where(chebyshev(F.col("cy"), F.col("cx")) <= search)
    inner = sent.groupBy(F.col("cy").alias("dy"), F.col("cx").alias("dx"), "distance").agg(F.percentile("v", F.lit(0.5)).alias("median"))
    ring = sent.where(F.col("distance").between(*RING)).groupBy(F.col("cy").alias("dy"), F.col("cx").alias("dx")).agg(F.percentile("v", F.lit(0.5)).alias("ring"))
    return inner.join(ring, ["dy", "dx"])


def strongest_contrast(surface: DataFrame, search: int, square_um: float = 2.0) -> DataFrame:
    """The offset whose value differs most from the median of the ring around it, relative to that: its contrast, sign,
    whether it lies on the edge of the search, the first distance at which half of the contrast is gone, and the ring."""
    profile = rings(surface, search)
    centre = profile.where("distance = 0 and ring > 0").withColumn("contrast", 1 - F.try_divide("median", "ring"))
    order = F.struct((-F.abs("contrast")).alias("a"), chebyshev(F.col("dy"), F.col("dx")).alias("far"), "dy", "dx", "contrast", "median", "ring")
    best = centre.agg(F.min(order).alias("b")).where("b is not null").select("b.dy", "b.dx", "b.contrast", F.col("b.median").alias("mean"), F.col("b.ring").alias("reference"))
    met = best.join(profile.drop("ring"), ["dy", "dx"]).withColumn("half", (F.col("mean") + F.col("reference")) / 2)
    gone = (F.col("distance") > 0) & F.when(F.col("reference") > F.col("mean"), F.col("median") >= F.col("half")).when(F.col("reference") < F.col("mean"), F.col("median") <= F.col("half")).otherwise(F.lit(False))
    width = F.min(F.when(gone, F.col("distance") * square_um)).alias("width_um")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("distance", "median"))), lambda x: x["median"]).alias("profile")  # six rows
    sign = F.when(F.col("contrast") > 0, "dip").when(F.col("contrast") < 0, "peak").otherwise("flat")
    return met.groupBy("dy", "dx", "contrast", "mean", "reference").agg(width, listed).select("*", sign.alias("sign"), (chebyshev(F.col("dy"), F.col("dx")) == search).alias("border"))


def optimum(stack: DataFrame, keys: list[str], minimise: bool = True) -> DataFrame:
    """The best lag of each surface, moved by at most half a step to the vertex of the parabola through it and its two
    neighbours on an axis, and the next local optimum, by value, Chebyshev distance and place."""
    s = stack.withColumn("m", F.col("v") if minimise else -F.col("v"))
    own = Window.partitionBy(*keys)
    first = s.groupBy(*keys).agg(F.min(F.struct("m", "dy", "dx")).alias("b"))
    near = with_shifts(s.select(*keys, F.col("dy").alias("_y"), F.col("dx").alias("_x"), F.col("m").alias("_m")), 1)
    around = near.groupBy(*keys, (F.col("_y") + F.col("dy")).alias("dy"), (F.col("_x") + F.col("dx")).alias("dx")).agg(F.min("_m").alias("least"))
    local = s.join(around, [*keys, "dy", "dx"]).where("m = least").join(first, keys).where((F.col("dy") != F.col("b.dy")) | (F.col("dx") != F.col("b.dx")))
    after = local.groupBy(*keys).agg(F.min(F.struct("m", chebyshev(F.col("dy"), F.col("dx")).alias("far"), "dy", "dx")).alias("n"))
    at = lambda y, x: F.max(F.when((F.col("dy") == F.col("b.dy") + y) & (F.col("dx") == F.col("b.dx") + x), F.col("m")))
    line = s.join(first, keys).groupBy(*keys, "b").agg(at(-1, 0).alias("up"), at(1, 0).alias("down"), at(0, -1).alias("left"), at(0, 1).alias("right"), F.max(chebyshev(F.col("dy"), F.col("dx"))).alias("radius"))

    def vertex(low: Column, high: Column) -> Column:
        bend = low - 2 * F.col("b.m") + high
        return F.coalesce(F.when(bend > 0, F.least(F.lit(0.5), F.greatest(F.lit(-0.5), F.try_divide(low - high, 2 * bend)))), F.lit(0.0))

    sign = 1 if minimise else -1
    return line.join(after, keys, "left").select(
        *keys, (F.col("b.dy") + vertex(F.col("up"), F.col("down"))).alias("dy"), (F.col("b.dx") + vertex(F.col("left"), F.col("right"))).alias("dx"), F.col("b.dy").alias("integer_dy"), F.col("b.dx").alias("integer_dx"),
        (sign * F.col("b.m")).alias("metric"), (chebyshev(F.col("b.dy"), F.col("b.dx")) == F.col("radius")).alias("boundary"), F.col("n.dy").alias("next_dy"), F.col("n.dx").alias("next_dx"), (sign * F.col("n.m")).alias("next_metric"),
    )


def blurred(dense: DataFrame, value: str, sigma: float, out: str, truncate: float = 4.0) -> DataFrame:
    """A Gaussian blur, the outside being 0: each cell sends itself, weighted, along rows and then along columns."""
    reach = int(truncate * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = F.array(*(F.lit(float(w)) for w in weight / weight.sum()))
    got = dense.select("r", "c", F.col(value).alias("_v"))
    for axis in ("r", "c"):
        other = "c" if axis == "r" else "r"
        sent = got.select(F.col(axis).alias("_at"), other, "_v", F.posexplode(weights).alias("_k", "_w"))
        got = sent.groupBy((F.col("_at") + F.col("_k") - reach).alias(axis), other).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    return dense.join(got.withColumnRenamed("_v", out), ["r", "c"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def prepared(dense: DataFrame, sigma: float = 8.0, bandpass: bool = True) -> DataFrame:
    """r, c, a, b: the mask and log(1 + counts) on the support, each less a blur of itself, and 0 off it."""
    on = F.col("support").cast("double")
    d = dense.select("r", "c", "support", (F.col("inside").cast("double") * on).alias("a"), (F.log1p("v") * on).alias("b"))
    if bandpass:
        d = blurred(blurred(d, "a", sigma, "_a"), "b", sigma, "_b").withColumn("a", (F.col("a") - F.col("_a")) * on).withColumn("b", (F.col("b") - F.col("_b")) * on)
    return d.select("r", "c", "a", "b")


def _normal(rows: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Sums of the normal equations of [1, y, x] for dy and dx over the rows where ``where`` holds."""
    y, x = F.col("y"), F.col("x")
    sums = {"n": F.lit(1.0), "sy": y, "sx": x, "syy": y * y, "sxx": x * x, "syx": y * x}
    for k in ("dy", "dx"):
        sums |= {f"t_{k}": F.col(k), f"ty_{k}": F.col(k) * y, f"tx_{k}": F.col(k) * x}
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(where, e)), F.lit(0.0)).alias(name) for name, e in sums.items()))


def _solved(sums: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Coefficients k0, ky, kx of dy and dx by Cramer's rule; null for fewer than three rows or rows on one line."""
    n, sy, sx, syy, sxx, syx = (F.col(k) for k in ("n", "sy", "sx", "syy", "sxx", "syx"))
    minor = [syy * sxx - syx * syx, sx * syx - sy * sxx, sy * syx - sx * syy, n * sxx - sx * sx, sx * sy - n * syx, n * syy - sy * sy]
    size = n * minor[0] + sy * minor[1] + sx * minor[2]
    ok = (n >= 3) & (size > tolerance * F.greatest(n * syy * sxx, F.lit(1e-300)))
    out = []
    for k in ("dy", "dx"):
        t, ty, tx = (F.col(f"{p}_{k}") for p in ("t", "ty", "tx"))
        for name, a, b, c in (("0", 0, 1, 2), ("y", 1, 3, 4), ("x", 2, 4, 5)):
            out.append(F.when(ok, F.try_divide(minor[a] * t + minor[b] * ty + minor[c] * tx, size)).alias(f"k{name}_{k}"))
    return sums.select(*keys, "n", *out)


def _residual(prefix: str = "") -> Column:
    """The larger of the two residuals of a row against the coefficients that it carries."""
    off = lambda k: F.abs(F.col(k) - (F.col(f"{prefix}k0_{k}") + F.col(f"{prefix}ky_{k}") * F.col("y") + F.col(f"{prefix}kx_{k}") * F.col("x")))
    return F.greatest(off("dy"), off("dx"))


COEFFICIENTS = [f"k{p}_{k}" for k in ("dy", "dx") for p in ("0", "y", "x")]


def affine_fit(rows: DataFrame, keys: list[str], where: Column | None = None, reject: float = 2.0) -> DataFrame:
    """[dy, dx] = [1, y, x] @ coefficients for each key's rows (y, x, dy, dx): least squares, once again without rows whose
    residual is above ``reject`` on either axis. Adds how many rows were kept; coefficients are null without a plane."""
    where = F.lit(True) if where is None else where
    first = _solved(_normal(rows, keys, where), keys).select(*keys, *(F.col(c).alias(f"_{c}") for c in COEFFICIENTS))
    again = rows.join(first, keys)
    return _solved(_normal(again, keys, where & F.coalesce(_residual("_") <= reject, F.lit(False))), keys).withColumnRenamed("n", "retained")


def affine_check(rows: DataFrame, keys: list[str], minimum: int = 12, tolerance: float = 1.0, share: float = 0.75) -> DataFrame:
    """Fits the usable regions of one colour of the chessboard (row, col), predicts those of the other, and if enough of them
    are within ``tolerance``, fits all. ``reason`` says why a fit is not accepted."""
    usable = rows.where("usable").withColumn("even", F.pmod(F.col("row") + F.col("col"), F.lit(2)) == 0)
    train = affine_fit(usable, keys, F.col("even"))
    final = affine_fit(usable, keys)
    met = usable.join(train.drop("retained"), keys)
    held = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("usable"), F.sum((~F.col("even")).cast("long")).alias("held_out"), F.sum((~F.col("even") & F.coalesce(_residual() <= tolerance, F.lit(False))).cast("long")).alias("held_out_pass"), F.max(F.col("k0_dy").isNotNull()).alias("trained"))
    both = rows.select(*keys).distinct().join(held, keys, "left").join(final, keys, "left")
    passed = F.coalesce(F.try_divide("held_out_pass", "held_out"), F.lit(0.0)) >= share
    reason = F.when(~F.coalesce("trained", F.lit(False)), "too few positions to train").when(~passed, "held-out prediction").when(F.col("k0_dy").isNull(), "too few positions").when(F.col("retained") < minimum, "too few regions remain")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(*keys, zero("usable"), zero("held_out"), zero("held_out_pass"), zero("retained"), *COEFFICIENTS, reason.isNull().alias("accepted"), reason.alias("reason"))


def block_draws(blocks: int, draws: int, seed: int) -> np.ndarray:
    """How often each draw with replacement takes each block; numpy's generator, as results must be those of its seed."""
    return np.random.default_rng(seed).multinomial(blocks, np.full(blocks, 1 / blocks), size=draws)


class _Blocks:
    """Blocks of a split grid, numbered along one axis over all parts of it, so that their numbers rise with the place."""

    def __init__(self, size: int, parts: int, block: int):
        self.edges = [k * size // parts for k in range(parts + 1)]
        each = [-(-(y - x) // block) for x, y in zip(self.edges, self.edges[1:])]
        self.first, self.block = [sum(each[:k]) for k in range(parts + 1)], block

    def part(self, at: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, self.edges[1:-1])).cast("array<long>"), lambda e: e <= at))

    def number(self, at: Column) -> Column:
        k = self.part(at)
        of = lambda values: F.get(F.array(*map(F.lit, values)).cast("array<long>"), k)
        return of(self.first) + F.floor((at - of(self.edges)) / self.block)

    def part_of(self, number: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, self.first[1:-1])).cast("array<long>"), lambda e: e <= number))


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of numbers, the same wherever it is computed."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            h = (h ^ np.asarray(x).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def resampled_blocks(blocks: int, draw: int, seed: int, region: int) -> np.ndarray:
    """How often a draw of as many blocks, with replacement, takes each: from hashes, so every task draws alike."""
    return np.bincount((_hashed(seed, region, draw, np.arange(blocks)) % np.uint64(blocks)).astype(np.int64), minlength=blocks)


def _drawn_surfaces(draws: int, seed: int):
    """The correlation ratio of one region at one shift: of all blocks (draw -1) and of every draw of them."""

    def work(key: tuple, group: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["region", "draw", "dy", "dx", "v"])
        if not group.num_rows or not blocks.num_rows:
            return empty
        region, dy, dx = (k.as_py() for k in key)
        place = np.stack([blocks.column(k).to_numpy() for k in ("gy", "gx")], axis=1)
        order = np.lexsort(place.T[::-1])
        place = place[order]
        total = np.stack([blocks.column(k).to_numpy()[order] for k in ("n", "s", "q")], axis=1).astype(float)
        wide = int(place[:, 1].max()) + 1
        own = np.searchsorted(place[:, 0] * wide + place[:, 1], group.column("gy").to_numpy() * wide + group.column("gx").to_numpy())
        bands, code = np.unique(group.column("band").to_numpy(), return_inverse=True)
        n, s = np.zeros((len(place), len(bands))), np.zeros((len(place), len(bands)))
        np.add.at(n, (own, code), group.column("n").to_numpy())
        np.add.at(s, (own, code), group.column("s").to_numpy())
        out = []
        for draw in range(-1, draws):
            w = np.ones(len(place)) if draw < 0 else resampled_blocks(len(place), draw, seed, region)
            nb, sb, (all_n, all_s, all_q) = w @ n, w @ s, w @ total
            far_n, far_s = all_n - nb.sum(), all_s - sb.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                between = np.where(nb > 0, sb * sb / nb, 0).sum() + (far_s * far_s / far_n if far_n > 0 else 0) - all_s * all_s / all_n
                out.append(float(between / (all_q - all_s * all_s / all_n)))
        k = len(out)
        v = np.array(out)
        return pa.table([pa.array([region] * k), pa.array(range(-1, draws), pa.int64()), pa.array([dy] * k), pa.array([dx] * k), pa.array(v, mask=~np.isfinite(v))], names=["region", "draw", "dy", "dx", "v"])

    return work


def _highest(radius: int, search: int):
    """The highest local maximum of a surface, above all of its eight neighbours, within ``search``; the first of equal ones."""
    side = 2 * radius + 1

    def work(key: tuple, group: pa.Table) -> pa.Table:
        region, draw = (k.as_py() for k in key)
        v = np.full((side + 2, side + 2), np.nan)
        v[group.column("dy").to_numpy() + radius + 1, group.column("dx").to_numpy() + radius + 1] = group.column("v").to_numpy(zero_copy_only=False)
        near = np.stack([v[1 + j : side + 1 + j, 1 + i : side + 1 + i] for j in (-1, 0, 1) for i in (-1, 0, 1) if j or i])
        centre = v[1:-1, 1:-1]
        with np.errstate(invalid="ignore"):
            hit = (centre > near).all(axis=0)  # false next to a place without a value
        lag = np.arange(-radius, radius + 1)
        hit &= (np.abs(lag)[:, None] <= search) & (np.abs(lag) <= search)
        k = int(np.argmax(np.where(hit, centre, -np.inf)))
        found = bool(hit.any())
        row = [region, draw, int(lag[k // side]), int(lag[k % side]), float(centre.reshape(-1)[k])] if found else [region, draw, None, None, None]
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["region", "draw", "dy", "dx", "eta2"])

    return work


def assess_regions(dense: DataFrame, height: int, width: int, divisions: int = 5, minimum: int = 30_000, *, search: int, block: int, draws: int = 200, seed: int = 7, stable: float = 0.95, baseline: int = 2) -> DataFrame:
    """The shift of a mask against counts in each part of a split of the grid, and whether to trust it; a row per part.

    Its shift is the highest local maximum of the correlation ratio of counts, each over its neighbourhood's mean, by distance
    band from the mask; locations beyond all bands, or under no location of the mask, are a band of their own. A part is
    usable if it has ``minimum`` locations of the mask in the support, if the shift lies inside the search, and if in at least
    ``stable`` of the resamples of its blocks the highest maximum is within one location. A block takes part if support
    lies within it or within the reach of a shift; bands come from the whole grid.

    All parts go on together: sums per block, shift and band come from one pass over tiles; each part and shift is then a
    group that draws its blocks by hashes, and each part and draw a surface."""
    radius = search + 1
    ys, xs = _Blocks(height, divisions, block), _Blocks(width, divisions, block)
    numbered = lambda d: d.withColumns({"gy": ys.number(F.col("r")), "gx": xs.number(F.col("c"))})
    region = (ys.part_of(F.col("gy")) * divisions + xs.part_of(F.col("gx"))).cast("long").alias("region")
    support = dense.where("support")
    values = cut(numbered(raster.corrected(dense, baseline).where("support").select("r", "c", "v")))
    bands = raster.distance_bands(dense).where("band >= 0")
    # the blocks that support reaches, with their own totals
    clip = lambda at, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), at))
    hit = lambda axis, k, size: F.explode(F.sequence(axis.number(clip(F.col(k) - radius, size)), axis.number(clip(F.col(k) + radius, size))))
    reached = support.select("r", "c").withColumn("gy", hit(ys, "r", height)).withColumn("gx", hit(xs, "c", width)).select("gy", "gx").distinct()
    own = values.groupBy("gy", "gx").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("double").alias(k)
    blocks = cut(reached.join(own, ["gy", "gx"], "left").select(region, "gy", "gx", zero("n"), zero("s"), zero("q")))
    # every part
    parts = dense.sparkSession.range(divisions * divisions).withColumnRenamed("id", "region")
    part = (ys.part(F.col("r")) * divisions + xs.part(F.col("c"))).cast("long").alias("region")
    inside = support.where("inside").select(part, "r", "c").groupBy("region").agg(F.count(F.lit(1)).alias("squares"), F.avg("r").alias("centroid_y"), F.avg("c").alias("centroid_x"))
    several = blocks.groupBy("region").agg(F.count(F.lit(1)).alias("blocks"))
    all_ = cut(parts.join(inside, "region", "left").join(several, "region", "left").withColumn("squares", F.coalesce("squares", F.lit(0))))
    tested = all_.where((F.col("squares") >= minimum) & F.col("blocks").isNotNull()).select("region")
    per = met_sums(bands, values.withColumn("y", F.col("v")), radius, ["band"], ["gy", "gx"], s=(0, 1)).withColumn("region", region)
    span = F.sequence(F.lit(-radius).cast("long"), F.lit(radius).cast("long"))
    shifts = blocks.join(F.broadcast(tested), "region").withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    by = ["region", "dy", "dx"]
    sums = per.join(F.broadcast(tested), "region").select(*by, "gy", "gx", "band", "n", "s")
    stack = sums.groupBy(*by).cogroup(shifts.groupBy(*by)).applyInArrow(_drawn_surfaces(draws, seed), "region long, draw long, dy long, dx long, v double")
    best = cut(stack.groupBy("region", "draw").applyInArrow(_highest(radius, search), "region long, draw long, dy long, dx long, eta2 double"))
    top = best.where("draw = -1 and eta2 is not null").select("region", F.col("dy").alias("y"), F.col("dx").alias("x"), "eta2")
    far = chebyshev(F.col("dy") - F.col("y"), F.col("dx") - F.col("x"))
    near = lambda most: (F.coalesce(F.sum((far <= most).cast("long")), F.lit(0)) / draws).alias("share_exact" if not most else "share_within_one")
    shares = best.where("draw >= 0").join(top.select("region", "y", "x"), "region").groupBy("region").agg(near(1), near(0))
    got = all_.join(top, "region", "left").join(shares, "region", "left")
    reason = F.when(F.col("squares") < minimum, F.lit(f"fewer than {minimum} locations of the mask in the support")).when(F.col("blocks").isNull(), "no tissue").when(F.col("eta2").isNull(), "no local maximum")
    reason = reason.when(chebyshev(F.col("y"), F.col("x")) >= search, "highest maximum on the edge of the search").when(F.coalesce("share_within_one", F.lit(0.0)) < stable, "not stable under resampling").otherwise("usable")
    status = F.when(F.col("squares") < minimum, "not tested").when(reason == "usable", "usable").otherwise("not registered")
    row, col = F.floor(F.col("region") / divisions), F.col("region") % divisions
    return got.select(
        row.alias("row"), col.alias("col"), "squares", "centroid_y", "centroid_x", F.coalesce("blocks", F.lit(0)).alias("blocks"), status.alias("status"), reason.alias("reason"),
        F.col("y").alias("dy"), F.col("x").alias("dx"), "eta2", "share_within_one", "share_exact",
    )


def assess(dense: DataFrame, height: int, width: int, search: int, block: int, draws: int = 200, seed: int = 7, stable: float = 0.95, baseline: int = 2) -> DataFrame:
    """:func:`assess_regions` of the whole grid, as one row."""
    got = assess_regions(dense, height, width, 1, 0, search=search, block=block, draws=draws, seed=seed, stable=stable, baseline=baseline)
    return got.select("status", "reason", "dy", "dx", "eta2", "share_within_one", "share_exact")


def fit_homography(points: DataFrame) -> tuple[np.ndarray, float]:
    """The projective map of (x, y) to (u, v) by least squares, and its largest residual over all points.

    Points are normalised to mean 0 and mean distance sqrt 2; the null vector comes from the 9 x 9 sums of their equations."""
    far = lambda a, b, ma, mb: F.sqrt((F.col(a) - F.col(ma)) ** 2 + (F.col(b) - F.col(mb)) ** 2)
    mean = points.agg(F.count(F.lit(1)).alias("n"), *(F.avg(k).alias(f"m_{k}") for k in "xyuv"))
    size = points.crossJoin(F.broadcast(mean)).groupBy("n", "m_x", "m_y", "m_u", "m_v").agg(F.avg(far("x", "y", "m_x", "m_y")).alias("s"), F.avg(far("u", "v", "m_u", "m_v")).alias("t")).first()
    if size is None or size["n"] < 4:
        raise ValueError("at least four matching points are needed")
    if size["s"] == 0 or size["t"] == 0:
        raise ValueError("all points are one")
    s, t = 2**0.5 / size["s"], 2**0.5 / size["t"]
    x, y, u, v = ((F.col(k) - size[f"m_{k}"]) * z for k, z in (("x", s), ("y", s), ("u", t), ("v", t)))
    one, zero = F.lit(1.0), F.lit(0.0)
    equations = [[-x, -y, -one, zero, zero, zero, u * x, u * y, u], [zero, zero, zero, -x, -y, -one, v * x, v * y, v]]
    got = points.agg(*(F.sum(sum((e[i] * e[j] for e in equations), zero)).alias(f"p{i}{j}") for i in range(9) for j in range(i, 9))).first()
    product = np.array([[got[f"p{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
    h = np.linalg.eigh(product)[1][:, 0].reshape(3, 3)
    move = lambda z, a, b: np.array([[z, 0, -z * a], [0, z, -z * b], [0, 0, 1]])
    h = np.linalg.inv(move(t, size["m_u"], size["m_v"])) @ h @ move(s, size["m_x"], size["m_y"])
    h = h / h[2, 2]
    from .grid import project

    px, py = project(h.tolist(), F.col("x"), F.col("y"))
    return h, float(points.agg(F.max(F.sqrt((px - F.col("u")) ** 2 + (py - F.col("v")) ** 2))).first()[0])


def grid_centres(col: Column, size_um: int) -> Column:
    """Centre of a cell of ``size_um`` on the grid of 2 um cells."""
    k = size_um / 2
    return k * col + (k - 1) / 2


def cyclic_displacement(a: DataFrame, b: DataFrame, side: int, reach: int) -> DataFrame:
    """dy, dx and the sum of products of two maps of ``side`` at every shift that wraps around."""
    sent = with_shifts(a.select("r", "c", F.col("v").alias("x")), reach)
    wrap = lambda k, d: F.pmod(F.col(k) + F.col(d), F.lit(side)).alias(k)
    return sent.select(wrap("r", "dy"), wrap("c", "dx"), "dy", "dx", "x").join(b.select("r", "c", "v"), ["r", "c"]).groupBy("dy", "dx").agg(F.sum(F.col("x") * F.col("v")).alias("v"))


def integral(dense: DataFrame, value: str) -> DataFrame:
    """r, c, total: sums over all cells up to each, one window along each axis."""
    along = lambda own, order: Window.partitionBy(own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("r", "c", F.sum(value).over(along("r", "c")).alias("_row")).select("r", "c", F.sum("_row").over(along("c", "r")).alias("total"))


def rectangle_sums(totals: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes`` (box, r0, c0, r1, c1; ends exclusive) with the sum of each, from the four corners of an integral table."""
    corner = F.explode(F.array(*(F.struct((F.col(r) - 1).alias("r"), (F.col(c) - 1).alias("c"), F.lit(sign).alias("sign")) for r, c, sign in (("r1", "c1", 1), ("r0", "c1", -1), ("r1", "c0", -1), ("r0", "c0", 1)))))
    met = boxes.select("box", corner.alias("k")).select("box", "k.*").join(totals, ["r", "c"], "left")
    return boxes.join(met.groupBy("box").agg(F.sum(F.col("sign") * F.coalesce("total", F.lit(0))).alias("total")), "box")

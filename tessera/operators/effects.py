"""Which genes tell two groups of cells or patches apart, and how methods compare on them."""

from __future__ import annotations

import numpy as np
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def group_effects(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Per gene (keys) of rows with a value x and a flag rich: the difference of means, the chance that a rich row is above a
    poor one (ties half), and that chance in the direction of the mean effect. Equal values are summed before they are
    ordered, so a window holds the distinct values of one gene."""
    rich = F.col("rich").cast("long")
    tied = dense.groupBy(*keys, "x").agg(F.sum(rich).alias("p"), F.sum(1 - rich).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("area", F.col("p") * (below + F.col("q") / 2))
    got = ranked.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("p").alias("n_rich"), F.sum("q").alias("n_poor"), F.sum(F.col("p") * F.col("x")).alias("sr"), F.sum(F.col("q") * F.col("x")).alias("sp"))
    effect = F.try_divide("sr", "n_rich") - F.try_divide("sp", "n_poor")
    auc = F.coalesce(F.try_divide("area", F.col("n_rich") * F.col("n_poor")), F.lit(0.5))
    return got.select(*keys, "n_rich", "n_poor", effect.alias("effect"), auc.alias("auc"), F.when(effect < 0, 1 - auc).otherwise(auc).alias("oriented_auc"))


def wins(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Wins, losses and ties of one method's values against another's over the genes that both have."""
    met = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    n = lambda c: F.count(F.when(c, 1))
    return met.agg(n(F.col("_a") > F.col("_b")).alias("wins"), n(F.col("_a") < F.col("_b")).alias("losses"), n(F.col("_a") == F.col("_b")).alias("ties"))


def labelled_cells(clusters: DataFrame, counts: DataFrame, wanted: list[int], genes: list[int]) -> DataFrame:
    """Cells whose cluster is one of ``wanted`` and that have a count of any of the label genes."""
    some = counts.where(F.col("feature_id").isin(genes) & (F.col("v") > 0)).select("cell").distinct()
    return clusters.where(F.col("cluster").isin(wanted)).join(some, "cell", "left_semi")


def eligible_genes(tables: list[DataFrame], least: float) -> DataFrame:
    """Genes (feature_id, patch, v) whose counts over the patches are enough and vary in every one of the tables."""
    out = None
    for t in tables:
        own = t.groupBy("feature_id").agg(F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi")).where((F.col("v") >= least) & (F.col("lo") < F.col("hi"))).select("feature_id")
        out = own if out is None else out.join(own, "feature_id", "left_semi")
    return out


def thinned(count: Column, *seed: Column) -> Column:
    """How many of ``count`` units fall on the first of two halves: each unit's coin is a bit of a hash of the seed and of its
    block of 64, so reruns agree wherever the row is."""
    n = count.cast("long")

    def heads(k: Column) -> Column:
        left = F.least(n - 64 * k, F.lit(64).cast("long"))  # units of this block
        mask = F.when(left > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - left).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.bit_count(F.xxhash64(*seed, k).bitwiseAND(mask))

    words = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n / 64)), heads)
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + x)


def split_half_reliability(counts: DataFrame, seed: int) -> DataFrame:
    """feature_id, reliability: the correlation over patches of two random halves of each gene's counts, raised to the whole
    by 2 r / (1 + r) and held between 0 and 1; 0 where it is undefined."""
    halves = counts.withColumn("a", thinned(F.col("v"), F.lit(seed), F.col("feature_id"), F.col("patch")).cast("double")).withColumn("b", F.col("v") - F.col("a"))
    k = halves.groupBy("feature_id").agg(*S.moments(F.col("a"), F.col("b"))).select("feature_id", S.pearson_null().alias("k"))
    return k.select("feature_id", F.when(F.col("k").isNull() | (F.col("k") <= -0.999999), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * F.col("k"), 1 + F.col("k"))))).alias("reliability"))


def mass_curve(genes: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """target, place, share: how many genes (feature_id, weight), from the most reliable on, hold each share of the weight."""
    order = Window.orderBy(F.desc("reliability"), "feature_id")  # a row per gene
    run = genes.withColumn("place", F.row_number().over(order).cast("long")).withColumn("upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = genes.agg(F.sum("weight").alias("total"))
    met = run.crossJoin(F.broadcast(total)).withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("upto") >= F.col("target") * F.col("total"))
    return met.groupBy("target").agg(F.min(F.struct("place", (F.col("upto") / F.col("total")).alias("share"))).alias("b")).select("target", "b.place", "b.share")


#: Cells of the tables that one batch of alignments fills at once.
ALIGN_CELLS = 8 << 20


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row, and how many there are."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), size.max(initial=0)), np.uint32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _align_batch(first: list[str], second: list[str]) -> list[tuple[int, str, str]]:
    """All pairs at once: a table of costs with an axis for the pairs, and a walk through it that all pairs take together."""
    a, rows = _letters(first)
    b, cols = _letters(second)
    n, high, wide = len(first), a.shape[1], b.shape[1]
    across = np.arange(wide + 1)
    cost = np.empty((high + 1, n, wide + 1), np.int32)
    cost[0] = across
    for i in range(high):
        best = cost[i] + 1
        best[:, 1:] = np.minimum(best[:, 1:], cost[i, :, :-1] + (a[:, i, None] != b))
        # from the left each step costs one more, so the least so far less its place is what counts
        cost[i + 1] = np.minimum.accumulate(best - across, axis=1) + across
    pair = np.arange(n)
    i, j, whole = rows.copy(), cols.copy(), cost[rows, pair, cols]
    top, low = np.zeros((n, high + wide), np.uint32), np.zeros((n, high + wide), np.uint32)
    at = np.full(n, high + wide)
    while (left := (i > 0) | (j > 0)).any():
        ia, jb = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        x = a[pair, ia] if high else np.zeros(n, np.uint32)
        y = b[pair, jb] if wide else np.zeros(n, np.uint32)
        here = cost[i, pair, j]
        both = (i > 0) & (j > 0) & (here == cost[ia, pair, jb] + (x != y))
        gap_above = ~both & (j > 0) & (here == cost[i, pair, jb] + 1)
        at = np.where(left, at - 1, at)
        go = np.flatnonzero(left)
        top[go, at[go]] = np.where(gap_above, 0x2D, x)[go]
        low[go, at[go]] = np.where(both | gap_above, y, 0x2D)[go]
        i, j = np.where(left & ~gap_above, ia, i), np.where(left & (both | gap_above), jb, j)
    text = lambda x, k: x[k, at[k] :].tobytes().decode("utf-32-le", "surrogatepass")
    return [(int(whole[k]), text(top, k), text(low, k)) for k in range(n)]


def aligned(a: Column, b: Column) -> Column:
    """cost, first, second: two texts aligned at the fewest edits, with - for gaps. Read from the end, of equal ways a pair comes
    before a gap in the first text and that before a gap in the second. Null for a null text.

    Pairs of about the same length share a table; one pair takes four bytes for each pair of letters."""

    def batch(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None, None)] * len(x)
        some = [k for k, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        some.sort(key=lambda k: (len(x[k]), len(y[k])))
        while some:
            take = len(some)
            while take > 1 and take * (len(x[some[take - 1]]) + 1) * (max(len(y[k]) for k in some[:take]) + 1) > ALIGN_CELLS:
                take //= 2
            for k, got in zip(some[:take], _align_batch([x[k] for k in some[:take]], [y[k] for k in some[:take]])):
                out[k] = got
            some = some[take:]
        return pd.DataFrame(out, columns=["cost", "first", "second"]).astype({"cost": "Int32"})

    return F.pandas_udf(batch, "cost int, first string, second string")(a, b)

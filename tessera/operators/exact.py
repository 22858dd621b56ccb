"""Exact aggregates that no order of rows changes: sums of doubles, and order statistics by selection.

Sums add integers per binary exponent; selections count, and keep no values of a group in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

#: Bits of the digits by which selection narrows the range of a rank.
DIGIT_BITS = 16


@F.pandas_udf(T.StructType([T.StructField("m", T.LongType()), T.StructField("e", T.IntegerType())]))
def _split(x: pd.Series) -> pd.DataFrame:
    """x = m 2^e with an integer m below 2^53."""
    m, e = np.frexp(x.to_numpy(float))
    return pd.DataFrame({"m": np.ldexp(m, 53).astype(np.int64), "e": e.astype(np.int32) - 53})


@F.pandas_udf(T.DoubleType())
def _rounded(parts: pd.Series) -> pd.Series:
    """The double next to the sum of s 2^e, the even one of two."""

    def one(terms: list) -> float:
        if terms is None or not len(terms):
            return 0.0
        low = min(t["e"] for t in terms)
        total = sum(int(t["s"]) << (t["e"] - low) for t in terms)
        try:
            return total / (1 << -low) if low < 0 else float(total << low)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return pd.Series([one(t) for t in parts], dtype=float)


def exact_sums(df: DataFrame, keys: Sequence[str], **values: Column | str) -> DataFrame:
    """keys and a column per value: its sum over the rows of each key, rounded once, so it is the same to the last bit for any
    partitions and order. Nulls are left out and a sum of none is null; an infinity or nan gives what adding does.

    Doubles become integers by their binary exponent, which Spark adds up with partial aggregates: for a key and value at
    most one row for each of the 2,100 exponents reaches the rounding."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_x")) for name, v in values.items())))
    rows = df.select(*keys, each.alias("_v")).select(*keys, "_v._name", "_v._x")
    odd = F.isnan("_x") | F.col("_x").isin(float("inf"), float("-inf"))
    plain = rows.where(F.col("_x").isNotNull() & ~odd).withColumn("_p", _split("_x")).groupBy(*keys, "_name", F.col("_p.e").alias("_e")).agg(F.sum(F.col("_p.m").cast("decimal(38,0)")).alias("_s"))
    total = plain.groupBy(*keys, "_name").agg(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("_t")).withColumn("_x", _rounded("_t")).drop("_t")
    other = rows.where(odd).groupBy(*keys, "_name").agg(F.sum("_x").alias("_x"))
    both = total.unionByName(other).groupBy(*keys, "_name").agg(F.sum("_x").alias("_x"))
    pick = [F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in values]
    known = both.groupBy(*keys).agg(*pick)
    if not keys:
        return known
    return df.select(*keys).distinct().alias("k").join(known.alias("v"), [F.col(f"k.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys], "left").select(*(F.col(f"k.{k}").alias(k) for k in keys), *(F.col(f"v.{name}") for name in values))


@F.pandas_udf(T.LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Integers in the order of the doubles: nan last, and one zero."""
    bits = (np.where(np.isnan(x), np.nan, x.to_numpy(float)) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits))


@F.pandas_udf(T.DoubleType())
def _value(key: pd.Series) -> pd.Series:
    k = key.to_numpy(np.int64)
    return pd.Series(np.where(k < 0, np.int64(-(2**63)) - k - 1, k).view(np.float64))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, **parts: float) -> DataFrame:
    """keys and a column per part: the exact quantile of the double column ``value``, interpolated between the two rows next to
    it; nulls are left out, and a key without a value has no row.

    Values are read as integers in their order. Each round counts, within the ranges that hold a wanted rank, the rows of
    each of 2^16 equal parts, and goes on with the part that the rank falls in: four rounds, each a partial aggregate and
    a window over the parts of one range. All keys and parts go on together, and rows outside all ranges are dropped."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    own = list(names.values())
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in names.items()), _ordered(F.col(value).cast("double")).alias("_x"))
    rows = cut(rows.groupBy(*own, "_x").agg(F.count(F.lit(1)).alias("_n")))
    n = rows.groupBy(*own).agg(F.sum("_n").alias("_all"))
    at = F.explode(F.array(*(F.struct(F.lit(name).alias("part"), F.lit(float(p)).alias("p")) for name, p in parts.items())))
    asked = n.withColumn("a", at).withColumn("place", F.col("a.p") * (F.col("_all") - 1))
    ranks = asked.withColumn("rank", F.explode(F.array(F.floor("place"), F.ceil("place")))).select(*own, "rank").distinct()
    state = ranks.withColumns({"_hi": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")})
    same = lambda a, b, more=(): [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*own, *more)]
    left = rows.withColumn("_hi", F.lit(0).cast("long"))
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        # an arithmetic shift keeps the order; the first range holds all
        part = F.shiftright("_x", shift)
        hist = left.groupBy(*own, "_hi", part.alias("_part")).agg(F.sum("_n").alias("_c"))
        run = hist.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*own, "_hi").orderBy("_part")))
        met = state.alias("s").join(run.alias("h"), same("s", "h", ["_hi"])).where((F.col("rank") - F.col("_below") >= F.col("_upto") - F.col("_c")) & (F.col("rank") - F.col("_below") < F.col("_upto")))
        state = cut(met.select(*(F.col(f"s.{k}").alias(k) for k in own), "rank", F.col("_part").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below")))
        if shift:
            ranges = state.select(*own, "_hi").distinct()
            left = left.drop("_hi").withColumn("_hi", part).alias("l").join(ranges.alias("r"), same("l", "r", ["_hi"]), "left_semi")
    found = state.select(*own, "rank", _value("_hi").alias("_v"))
    low = asked.alias("q").join(found.alias("f"), [*same("q", "f"), F.col("rank") == F.floor("place")]).select(*(F.col(f"q.{k}").alias(k) for k in own), "a", "place", F.col("_v").alias("_low"))
    both = low.alias("q").join(found.alias("f"), [*same("q", "f"), F.col("rank") == F.ceil("place")])
    frac = F.col("place") - F.floor("place")
    got = both.select(*(F.col(f"q.{k}").alias(k) for k in own), F.col("a.part").alias("part"), F.when(frac == 0, F.col("_low")).otherwise((1 - frac) * F.col("_low") + frac * F.col("_v")).alias("_v"))
    return got.groupBy(*own).agg(*(F.max(F.when(F.col("part") == name, F.col("_v"))).alias(name) for name in parts)).select(*(F.col(n).alias(k) for k, n in names.items()), *parts)

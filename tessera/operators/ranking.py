"""Ranks, curves and top lists. Global orders run in range buckets with offsets, so no task holds a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Buckets at least, and rows of a bucket beyond which there are more.
BUCKETS, BUCKET_ROWS = 64, 1_000_000


def cumulative(df: DataFrame, order: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``before_x`` for each x in ``sums``: its total over rows with a smaller ``order``. Rows have distinct orders.

    Approximate quantiles of the order, a number per bucket, make the ranges; buckets are as many as the rows need."""
    df = cut(df)  # read for the quantiles, the totals and the rows
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    bounds = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.2 / buckets)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("_bucket", place)
    totals = dealt.groupBy("_bucket").agg(*(F.sum(x).alias(f"_t_{x}") for x in sums))
    by = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    offsets = totals.select("_bucket", *(F.coalesce(F.sum(f"_t_{x}").over(by), F.lit(0)).alias(f"_o_{x}") for x in sums))
    own = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "_bucket")
    for x in sums:
        out = out.withColumn(f"before_{x}", F.col(f"_o_{x}") + F.coalesce(F.sum(x).over(own), F.lit(0)))
    return out.drop("_bucket", *(f"_o_{x}" for x in sums))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the place of each row from 1 by ``order``, nulls first.

    Rows are range-partitioned and sorted, and written with their row number within the partition; only the partitions' row
    counts are added up, so no task holds all rows."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    offsets = counts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """1-based ranks with ties averaged."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulative(counts, value, ["_n"]).select(F.col(value).alias("_v"), (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def roc_and_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Tie-aware area under the ROC curve and average precision; 0.5 and the prevalence with one class."""
    groups = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    run = cumulative(groups, "s", ["p", "q"])
    all_ = groups.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    met = run.crossJoin(F.broadcast(all_))  # one row
    above_p, above_q = F.col("all_p") - F.col("before_p"), F.col("all_q") - F.col("before_q")
    got = met.agg(
        F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("area"), F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.try_divide(above_p, above_p + above_q)).alias("ap"),
        F.first("all_p").alias("all_p"), F.first("all_q").alias("all_q"),
    )
    one = (F.col("all_p") == 0) | (F.col("all_q") == 0)
    return got.select(
        F.round(F.when(one, F.lit(0.5)).otherwise(F.try_divide(F.col("area"), F.col("all_p") * F.col("all_q"))), 6).alias("auc"),
        F.round(F.when(one, F.try_divide(F.col("all_p"), F.col("all_p") + F.col("all_q"))).otherwise(F.col("ap")), 6).alias("average_precision"), F.col("all_p").alias("positives"), F.col("all_q").alias("negatives"),
    )


def rank_deciles(df: DataFrame, value: str, key: str, parts: int = 10) -> DataFrame:
    """Equal-count parts in stable order of value and key: min(parts - 1, i * parts div n). Rows are numbered by ranges of both, so
    rows of one value need not be in one task."""
    placed = numbered(df, [value, key], "_i")
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    return placed.crossJoin(F.broadcast(n)).withColumn("decile", F.least(F.lit(parts - 1), F.floor((F.col("_i") - 1) * parts / F.col("_all")))).drop("_i", "_all")


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(key)).limit(k)


def concentration(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Share of the k largest values in the total."""
    top = top_k(df, value, key, k).agg(F.sum(value).alias("top"))
    return top.crossJoin(df.agg(F.sum(value).alias("total"))).select(F.lit(k).alias("k"), F.round(F.try_divide("top", "total"), 6).alias("share"))


def distribution_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Total variation and Jensen-Shannon divergence in nats of two normalised columns; a side without mass is all zeros."""
    total = df.agg(F.sum(a).alias("_total_a"), F.sum(b).alias("_total_b"))
    p = F.coalesce(F.try_divide(F.col(a), F.col("_total_a")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col(b), F.col("_total_b")), F.lit(0.0))
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    with_ = df.crossJoin(F.broadcast(total)).select(p.alias("p"), q.alias("q"), ((p + q) / 2).alias("m"))
    return with_.agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("tv"), F.round(F.sum(part(F.col("p"), F.col("m")) + part(F.col("q"), F.col("m"))) / 2, 6).alias("jsd"))

"""Comparing, decomposing and aggregating sparse feature-by-cell matrices (feature_id, r, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .exact import exact_sums

KEY = ["feature_id", "r", "c"]


def align(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The union of keys with both values, 0 where missing."""
    left, right = a.select(*key, F.col("v").alias("a")), b.select(*key, F.col("v").alias("b"))
    return left.join(right, key, "full_outer").select(*key, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def matrix_compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Masses, ratio, L1, exact entries, cosine, total variation and correlation over the union of entries."""
    x, y = F.col("a"), F.col("b")
    masses = a.agg(F.sum("v").alias("ma")).crossJoin(b.agg(F.sum("v").alias("mb")))  # one row each, so that one aligned pass is enough
    got = align(a, b).crossJoin(F.broadcast(masses)).agg(
        F.count(F.lit(1)).alias("entries"), F.sum((x > 0).cast("long")).alias("nnz_a"), F.sum((y > 0).cast("long")).alias("nnz_b"), F.sum(F.abs(x - y)).alias("l1"),
        F.sum((F.abs(x - y) <= tolerance).cast("long")).alias("exact"), (F.sum(F.abs(F.try_divide(x, F.col("ma")) - F.try_divide(y, F.col("mb")))) / 2).alias("tv"), *S.moments(x, y),
    )
    return got.select(
        "entries", "nnz_a", "nnz_b", F.col("sx").alias("mass_a"), F.col("sy").alias("mass_b"), F.round(F.try_divide("sx", "sy"), 6).alias("mass_ratio"), "l1", "exact",
        F.round(S.cosine_equal1(), 6).alias("cosine"), F.round("tv", 6).alias("tv"), F.round(S.pearson_equal1(), 6).alias("pearson"),
    )


def axis_totals(a: DataFrame, b: DataFrame, axis: list[str]) -> DataFrame:
    total = lambda d: d.groupBy(*axis).agg(F.sum("v").alias("v"))
    return align(total(a), total(b), axis)


def axis_compare(a: DataFrame, b: DataFrame, axis: list[str]) -> DataFrame:
    """Correlations and distances of two matrices' totals along an axis."""
    x, y = F.col("a"), F.col("b")
    both = axis_totals(a, b, axis)
    got = both.agg(*S.moments(x, y))
    logs = both.select(F.log1p("a").alias("a"), F.log1p("b").alias("b")).agg(*S.moments(x, y)).select(F.round(S.pearson_equal1(), 6).alias("pearson_log1p"))
    return got.crossJoin(logs).select("n", F.round(S.pearson_equal1(), 6).alias("pearson"), "pearson_log1p", F.round(S.cosine_equal1(), 6).alias("cosine"))


def shared_excess(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Elementwise minimum and the excess of either side, summed by ``by``."""
    x, y = F.col("a"), F.col("b")
    return align(a, b).groupBy(*by).agg(F.sum(F.least(x, y)).alias("shared"), F.sum(F.greatest(x - y, F.lit(0.0))).alias("a_only"), F.sum(F.greatest(y - x, F.lit(0.0))).alias("b_only"))


def nesting_audit(base: DataFrame, policy: DataFrame, key: list[str]) -> DataFrame:
    """How a policy's field differs from its base: cells higher, lower and equal, signed masses, extremes, superset. Masses are
    exact sums, so they are the same for any partitions."""
    d = align(policy, base, key).withColumn("d", F.col("a") - F.col("b"))
    masses = exact_sums(d, [], gained=F.greatest("d", F.lit(0.0)), lost=F.least("d", F.lit(0.0)))
    counts = d.agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.col("d") > 0).cast("long")).alias("higher"), F.sum((F.col("d") < 0).cast("long")).alias("lower"), F.sum((F.col("d") == 0).cast("long")).alias("equal"),
        F.min("d").alias("least"), F.max("d").alias("most"), F.every(F.col("d") >= 0).alias("superset"),
    )
    return counts.crossJoin(F.broadcast(masses))  # one row each


def increment_field(policy: DataFrame, strict: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Policy minus strict by cell; a loss beyond the tolerance is an error."""
    d = align(policy, strict).withColumn("d", F.col("a") - F.col("b"))
    checked = F.when(F.col("d") < -tolerance, F.raise_error(F.lit("the policy loses mass"))).otherwise(F.greatest("d", F.lit(0.0)))
    return d.withColumn("d", checked.cast("double")).groupBy("r", "c").agg(F.sum("d").alias("v")).where("v > 0")


def aggregate_cells(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Matrix columns summed by the label of their cell; mass without a label is left out."""
    return matrix.join(cells.select("r", "c", "label"), ["r", "c"]).groupBy("feature_id", "label").agg(F.sum("v").alias("v"))


def expand_uniform(coarse: DataFrame, children: DataFrame, factor: int) -> DataFrame:
    """Spreads coarse mass over the supported children of each parent."""
    kids = children.select("r", "c", F.floor(F.col("r") / factor).alias("pr"), F.floor(F.col("c") / factor).alias("pc"))
    count = kids.groupBy("pr", "pc").agg(F.count(F.lit(1)).alias("k"))
    share = coarse.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "v").join(count, ["pr", "pc"]).select("pr", "pc", (F.col("v") / F.col("k")).alias("v"))
    return kids.join(share, ["pr", "pc"]).select("r", "c", "v")


def residuals_by_feature(a: DataFrame, b: DataFrame, weights: DataFrame) -> DataFrame:
    """Per feature: totals, shared mass, residuals, and their part inside weighted cells (r, c, w)."""
    x, y = F.col("a"), F.col("b")
    d = align(a, b).join(weights, ["r", "c"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    over, under = F.greatest(x - y, F.lit(0.0)), F.greatest(y - x, F.lit(0.0))
    got = d.groupBy("feature_id").agg(
        F.sum(x).alias("total_a"), F.sum(y).alias("total_b"), F.sum(F.least(x, y)).alias("shared"), F.sum(over).alias("a_residual"), F.sum(under).alias("b_residual"),
        F.sum(over * F.col("w")).alias("a_inside"), F.sum(under * F.col("w")).alias("b_inside"), F.sum((x > 0).cast("long")).alias("nnz_a"),
    )
    return got.withColumn("a_fraction", F.round(S.safe_fraction(F.col("a_inside"), F.col("a_residual")), 6)).withColumn("b_fraction", F.round(S.safe_fraction(F.col("b_inside"), F.col("b_residual")), 6))


def effective_features(matrix: DataFrame) -> DataFrame:
    """Per cell the inverse of the sum of squared shares of its features."""
    return matrix.groupBy("r", "c").agg(F.round(F.try_divide(F.sum("v") * F.sum("v"), F.sum(F.col("v") * F.col("v"))), 6).alias("effective"))

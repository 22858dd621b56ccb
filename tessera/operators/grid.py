"""Grid cells: names, parents, shifts, affine moves and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dense_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("c"))


def bin_id(size_um: int, row: Column, col: Column) -> Column:
    """Name of the cell of ``size_um`` that holds a 2 um cell."""
    f = size_um // 2
    return F.concat(F.lit(f"s_{size_um:03d}um_"), F.floor(row / f).cast("string"), F.lit("_"), F.floor(col / f).cast("string"))


def parse_bin_id(name: Column) -> tuple[Column, Column, Column]:
    """Size, row and column of a cell name, padded and suffixed or not; nulls for other text."""
    pattern = r"^s_0*(\d+)um_0*(\d+)_0*(\d+)(?:-\d+)?$"
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)).cast("long")
    return part(1), part(2), part(3)


def parent(col: Column, factor: int) -> Column:
    return F.floor(col / factor)


def same_parent(r1: Column, c1: Column, r2: Column, c2: Column, factor: int) -> Column:
    return (parent(r1, factor) == parent(r2, factor)) & (parent(c1, factor) == parent(c2, factor))


def rectangle_shifts(spark: SparkSession, radius: int) -> DataFrame:
    """All (dy, dx) within ``radius``; (2 radius + 1)^2 rows by definition."""
    side = 2 * radius + 1
    return spark.range(side * side).select((F.floor(F.col("id") / side) - radius).alias("dy"), (F.col("id") % side - radius).alias("dx"))


def with_shifts(cells: DataFrame, radius: int) -> DataFrame:
    """Each cell with every shift, as columns dy and dx: a generator, no join."""
    span = F.sequence(F.lit(-radius).cast("long"), F.lit(radius).cast("long"))
    return cells.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))


def shift_cells(cells: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Moves cells and clips what leaves the grid."""
    moved = cells.withColumn("r", F.col("r") + dy).withColumn("c", F.col("c") + dx)
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def apply_affine(labels: DataFrame, coef: tuple[tuple[float, float], ...], height: int, width: int) -> DataFrame:
    """Moves labels by a rounded affine displacement; of those that meet, the last in row order wins."""
    shift = lambda k: F.rint(coef[0][k] + coef[1][k] * F.col("r") + coef[2][k] * F.col("c")).cast("long")
    moved = labels.select((F.col("r") + shift(0)).alias("nr"), (F.col("c") + shift(1)).alias("nc"), "label", F.struct("r", "c").alias("source"))
    inside = moved.where(F.col("nr").between(0, height - 1) & F.col("nc").between(0, width - 1))
    return inside.groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.max_by("label", "source").alias("label"), F.count(F.lit(1)).alias("met"))


def inverse_affine(coef: tuple[tuple[float, float], ...]) -> list[list[float]]:
    """The linear part that undoes a displacement [1, row, col] @ coef; an error if it turns the plane over or flattens it."""
    a, b, c, d = 1 + coef[1][0], coef[2][0], coef[1][1], 1 + coef[2][1]
    size = a * d - b * c
    if not size > 1e-8:
        raise ValueError("the displacement is singular or reverses orientation")
    return [[d / size, -b / size], [-c / size, a / size]]


def pull_affine(cells: DataFrame, coef: tuple[tuple[float, float], ...], height: int, width: int) -> DataFrame:
    """Every place of the grid whose source, the nearest place to it moved back, is one of ``cells`` (r, c, ...): r, c, what that
    cell carries, and where it lies (from_r, from_c). Halves go to the even place. No place gets two cells; a cell may come to
    several places or to none, which :func:`pull_account` counts."""
    inverse = inverse_affine(coef)
    y, x = F.col("r") - F.lit(float(coef[0][0])), F.col("c") - F.lit(float(coef[0][1]))
    back = [F.rint(F.lit(row[0]) * y + F.lit(row[1]) * x).cast("long") for row in inverse]
    places = dense_grid(cells.sparkSession, height, width).select("r", "c", back[0].alias("from_r"), back[1].alias("from_c"))
    inside = places.where(F.col("from_r").between(0, height - 1) & F.col("from_c").between(0, width - 1))
    return inside.join(cells.withColumnsRenamed({"r": "from_r", "c": "from_c"}), ["from_r", "from_c"])


def pull_account(cells: DataFrame, pulled: DataFrame, key: str) -> DataFrame:
    """key, before, after, dropped, repeated: a label's places before and after, its cells that come to no place, and places that
    repeat a cell; after = before - dropped + repeated."""
    uses = pulled.groupBy("from_r", "from_c").agg(F.count(F.lit(1)).alias("_n"))
    met = cells.select("r", "c", key).join(uses, (F.col("r") == F.col("from_r")) & (F.col("c") == F.col("from_c")), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("before"), F.sum("_n").alias("after"), F.sum((F.col("_n") == 0).cast("long")).alias("dropped"), F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("repeated"))


def claimed(labels: DataFrame, priority: list[Column]) -> DataFrame:
    """``labels`` (r, c, label, ...) with one row a place: where several cells claim it, the first by ``priority`` and then by label,
    with how many did (claims)."""
    order = F.struct(*(p.alias(f"p{k}") for k, p in enumerate([*priority, F.col("label")])))
    return labels.groupBy("r", "c").agg(F.min_by("label", order).alias("label"), F.count(F.lit(1)).alias("claims"))


def complete_parents(cells: DataFrame, factor: int) -> DataFrame:
    """pr, pc of the parents that have all their ``factor`` x ``factor`` places among ``cells``."""
    return cells.groupBy(parent(F.col("r"), factor).alias("pr"), parent(F.col("c"), factor).alias("pc")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == factor * factor).drop("_n")


def project(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A projective map of points; null at the pole."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    return F.try_divide(h[0][0] * x + h[0][1] * y + h[0][2], w), F.try_divide(h[1][0] * x + h[1][1] * y + h[1][2], w)


def remap_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of cells whose state appears, disappears, changes or stays, over the union of cells."""
    both = before.select("r", "c", F.col("label").alias("a")).join(after.select("r", "c", F.col("label").alias("b")), ["r", "c"], "full_outer")
    a, b = F.col("a"), F.col("b")
    kind = F.when(a.isNull(), "appears").when(b.isNull(), "disappears").when(a == b, "stays").otherwise("changes")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cells"))

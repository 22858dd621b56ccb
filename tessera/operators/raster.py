"""Fields on the grid: box means, distance bands, growth, shift surfaces and local extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import with_shifts
from .tiles import met_sums
from .transforms import squared_distances


def box_sums(dense: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Sums over the (2 radius + 1)^2 box, outside the grid as 0: one window along each axis."""
    rows = Window.partitionBy("r").orderBy("c").rangeBetween(-radius, radius)
    cols = Window.partitionBy("c").orderBy("r").rangeBetween(-radius, radius)
    return dense.withColumn("_row", F.sum(value).over(rows)).withColumn(out, F.sum("_row").over(cols)).drop("_row")


def corrected(dense: DataFrame, baseline: int = 2) -> DataFrame:
    """Counts over the mean of supported counts in their box; 0 off support or where that mean is 0."""
    ready = dense.withColumn("_v", F.when(F.col("support"), F.col("v")).otherwise(0.0)).withColumn("_n", F.col("support").cast("long"))
    summed = box_sums(box_sums(ready, "_v", baseline, "_sv"), "_n", baseline, "_sn")
    mean = F.try_divide(F.col("_sv"), F.col("_sn"))
    return summed.withColumn("v", F.when(F.col("support") & (mean > 0), F.try_divide(F.col("v"), mean)).otherwise(0.0)).drop("_v", "_n", "_sv", "_sn")


def _disc(radius: int) -> Column:
    return F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= radius * radius


def distance_bands(dense: DataFrame, outer: int = 6) -> DataFrame:
    """Band of each cell: 0.. inside by distance to the outside, 3 + floor of the distance beyond the edge outside, -1 beyond
    ``outer``. Distances are exact at any range; without an inside, or an outside, cells are as far as can be."""
    far = squared_distances(dense.withColumn("outside", ~F.col("inside")), ["inside", "outside"])
    got = dense.join(far, ["r", "c"])
    into = F.col("d2_outside")
    inner = F.when(into <= 1, 2).when(into <= 4, 1).otherwise(0)
    out = F.when(F.col("d2_inside") <= outer * outer, 2 + F.ceil(F.sqrt("d2_inside"))).otherwise(-1)
    return got.select("r", "c", "v", F.when(F.col("inside"), inner).otherwise(out).cast("int").alias("band"))


def grow_labels(labels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Every cell within ``radius`` of a label takes the nearest one; ties go to the smaller label."""
    sent = with_shifts(labels.select("r", "c", "label"), radius).where(_disc(radius))
    near = F.struct((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("d2"), "label")
    grown = sent.groupBy((F.col("r") + F.col("dy")).alias("r"), (F.col("c") + F.col("dx")).alias("c")).agg(F.min(near).alias("near"))
    return grown.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select("r", "c", F.col("near.label").alias("label"), F.col("near.d2").alias("d2"))


def shift_surface(dense: DataFrame, radius: int) -> DataFrame:
    """Mean count under the mask at every shift, over supported cells."""
    met = met_sums(dense.where("inside"), dense.where("support").withColumn("y", F.col("v")), radius, total=(0, 1))
    return met.withColumn("mean", F.round(F.try_divide("total", "n"), 6))


def ncc_surface(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Correlation at every shift over joint support; null for fewer than three cells or a constant side."""
    got = met_sums(a.withColumn("x", F.col("v")), b.withColumn("y", F.col("v")), radius, sx=(1, 0), sy=(0, 1), sxx=(2, 0), syy=(0, 2), sxy=(1, 1))
    n = F.col("n")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return got.select("dy", "dx", "n", F.round(F.when((n >= 3) & (spread > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))), 6).alias("ncc"))


def mi_surface(a: DataFrame, b: DataFrame, radius: int, bins: int = 8) -> DataFrame:
    """Mutual information in nats of equal-width codes at every shift."""

    def coded(d: DataFrame, name: str) -> DataFrame:
        ends = d.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        code = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0)))))
        return d.crossJoin(F.broadcast(ends)).select("r", "c", code.alias(name))

    met = met_sums(coded(a, "x"), coded(b, "y"), radius, ["x"], ["y"]).withColumnRenamed("n", "k")
    at = Window.partitionBy("dy", "dx")  # bins^2 rows
    p = met.withColumn("n", F.sum("k").over(at)).withColumn("kx", F.sum("k").over(Window.partitionBy("dy", "dx", "x"))).withColumn("ky", F.sum("k").over(Window.partitionBy("dy", "dx", "y")))
    return p.groupBy("dy", "dx").agg(F.round(F.sum(F.col("k") / F.col("n") * F.ln(F.col("k") * F.col("n") / (F.col("kx") * F.col("ky")))), 6).alias("mi"))


def eta2_surface(bands: DataFrame, values: DataFrame, radius: int) -> DataFrame:
    """Correlation ratio of values by distance band at every shift; an empty band adds nothing."""
    per = met_sums(bands, values.withColumn("y", F.col("v")), radius, ["band"], s=(0, 1), q=(0, 2))
    all_ = per.groupBy("dy", "dx").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return all_.select("dy", "dx", F.round(F.try_divide(F.col("between") - mean, F.col("q") - mean), 6).alias("eta2"))


def local_maxima(surface: DataFrame, value: str, search: int) -> DataFrame:
    """Points strictly above all of their eight neighbours, within ``search`` of the centre."""
    near = with_shifts(surface.select(F.col("dy").alias("y"), F.col("dx").alias("x"), F.col(value).alias("v")), 1).where("dy <> 0 or dx <> 0")
    round_ = near.groupBy((F.col("y") + F.col("dy")).alias("dy"), (F.col("x") + F.col("dx")).alias("dx")).agg(F.max("v").alias("_most"), F.count("v").alias("_k"))
    return surface.join(round_, ["dy", "dx"]).where((F.col("_k") == 8) & (F.col(value) > F.col("_most")) & (F.greatest(F.abs("dy"), F.abs("dx")) < search)).select("dy", "dx", value)

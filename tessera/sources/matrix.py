"""Matrix Market directories (features, barcodes, matrix) as sparse tables, and tables as such directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import parse_bin_id
from ..operators.ranking import numbered
from .lines import numbered_lines


def _found(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a member of a directory, compressed or not, one file or a folder of parts."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in (f"{folder}/{name}", f"{folder}/{name}.gz"):
        if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
            return path
    raise FileNotFoundError(f"{folder}/{name}")


def feature_ids(spark: SparkSession, folder: str) -> DataFrame:
    """i, feature_id: the feature axis alone."""
    return numbered_lines(spark, _found(spark, folder, "features.tsv"), across=True).select(F.col("number").alias("i"), F.split("value", "\t")[0].alias("feature_id"))


def read_mex(spark: SparkSession, folder: str) -> DataFrame:
    """feature_id, r, c, v of a Matrix Market directory, compressed or not. Zeros go; an entry twice, one outside of the
    declared axes or another number of entries than declared fails."""
    _, row, col = parse_bin_id(F.col("value"))
    barcodes = numbered_lines(spark, _found(spark, folder, "barcodes.tsv"), across=True).select(F.col("number").alias("j"), row.alias("r"), col.alias("c"))
    body = numbered_lines(spark, _found(spark, folder, "matrix.mtx"), across=True).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    first = body.agg(F.min(F.struct("number", "value"))).first()[0]  # the sizes are the first line that is no comment
    rows, columns, entries = (int(x) for x in first["value"].split())
    cells = body.where(F.col("number") != first["number"]).select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("v"))
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~F.col("i").between(1, rows) | ~F.col("j").between(1, columns) | F.col("v").isNull()).cast("long")), F.lit(0)).alias("odd")).first()
    if found["n"] != entries or found["odd"]:
        raise ValueError("the matrix has other entries than it declares")
    summed = cells.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("_n"))
    once = summed.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("an entry twice")).cast("boolean"))).where("v <> 0")
    return once.join(feature_ids(spark, folder), "i").join(barcodes, "j").select("feature_id", "r", "c", "v")


def write_mex(matrix: DataFrame, folder: str) -> None:
    """A matrix (feature_id, r, c, v) as a compressed Matrix Market directory; axes in the order of their names.

    Axes are numbered by ranges, and every member is a folder of parts in the order of their names, which are its lines."""
    f = numbered(matrix.select("feature_id").distinct(), ["feature_id"], "i")
    b = numbered(matrix.select("r", "c").distinct(), ["r", "c"], "j")
    name = F.concat(F.lit("s_002um_"), F.lpad(F.col("r").cast("string"), 5, "0"), F.lit("_"), F.lpad(F.col("c").cast("string"), 5, "0"), F.lit("-1"))
    body = matrix.join(f, "feature_id").join(b, ["r", "c"]).select("i", "j", F.concat_ws(" ", "i", "j", F.col("v").cast("string")).alias("value"))
    before = lambda k, value: [F.lit(k).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), value.alias("value")]
    sizes = matrix.agg(F.countDistinct("feature_id").alias("f"), F.countDistinct("r", "c").alias("b"), F.count(F.lit(1)).alias("n")).select(*before(0, F.concat_ws(" ", "f", "b", "n")))
    head = matrix.sparkSession.range(1).select(*before(-1, F.lit("%%MatrixMarket matrix coordinate real general")))

    def written(d: DataFrame, order: list[str], line: Column, part: str) -> None:
        d.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.option("compression", "gzip").text(f"{folder}/{part}")

    written(f, ["i"], F.concat_ws("\t", "feature_id", "feature_id", F.lit("Gene Expression")), "features.tsv")
    written(b, ["j"], name, "barcodes.tsv")
    written(head.unionByName(sizes).unionByName(body), ["i", "j"], F.col("value"), "matrix.mtx")


def axis_totals(matrix: DataFrame) -> DataFrame:
    """Totals of both axes in one pass: axis, feature_id, r, c, v."""
    got = matrix.groupingSets([["feature_id"], ["r", "c"]], "feature_id", "r", "c").agg(F.sum("v").alias("v"), F.grouping("feature_id").alias("g"))
    return got.select(F.when(F.col("g") == 0, "feature").otherwise("bin").alias("axis"), "feature_id", "r", "c", "v")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe table with # comments: genes with an included probe and none that is excluded."""
    p = spark.read.option("header", True).option("comment", "#").csv(path)
    keep = F.lower("included") == "true"
    return p.groupBy("gene_id").agg(F.count(F.lit(1)).alias("probes"), (F.bool_or(keep) & ~F.bool_or(~keep)).alias("eligible"))


def write_field(field: DataFrame, path: str) -> None:
    """A sparse field as compressed text, nonzero cells only; fails if the place is taken."""
    field.where("v <> 0").select("r", "c", "v").write.mode("errorifexists").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

"""Text tables of reads, molecules, fields and priors: typed reading, checks, and the tables that methods work on.

Readers are lazy and fail where a value does not parse; checks of keys and sums are queries that :func:`require` runs.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import parse_bin_id
from ..operators.lineage import dealt
from .lines import numbered_lines

#: Columns of the tables by name, in file order.
SCHEMAS = {
    "reads": "read_id string, feature_id string, umi string, unit string, eligible boolean",
    "molecules": "umi_mode string, product string, feature_id string, umi string, unit string, member_read_ids string",
    "cliques": "clique_id string, feature_id string, umi string, r long, c long, posterior double, member_read_ids string",
    "candidates": "read_id string, candidate_count int, r long, c long, e1 int, e2 int",
    "field": "unit_2um string, molecule_mass double",
    "prior": "half string, idx long, sequence string, reads long",
    "broad": "r long, c long, molecules long",
    "hashes": "read_id string, action string, feature_id string",
    "compartments": "r long, c long, in_nucleus boolean, in_cell boolean",
    "weights": "r long, c long, nucleus double, cytoplasm double, cell double",
}


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A table of tab-separated text, compressed or not; an empty field is null and a wrong one an error."""
    return spark.read.schema(schema).option("header", header).option("sep", "\t").option("nullValue", "").option("mode", "FAILFAST").option("enforceSchema", False if header else True).csv(path)


def write_tsv(df: DataFrame, path: str, missing: str = "", header: bool = True, compression: str = "gzip") -> None:
    """Writes a table as compressed text, NaN as ``missing``; refuses an empty table and a place that is taken."""
    if df.isEmpty():
        raise ValueError("an empty table is not written")
    number = lambda n, t: F.when(F.isnan(n), F.lit(missing)).otherwise(F.col(n).cast("string")).alias(n) if t in ("double", "float") else F.col(n)
    df.select(*(number(n, t) for n, t in df.dtypes)).write.mode("errorifexists").option("sep", "\t").option("header", header).option("nullValue", missing).option("emptyValue", "").option("compression", compression).csv(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Compressed text in one folder per shard of the key's hash, so that equal keys are in one file."""
    sharded = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    sharded.repartition(shards, "shard").write.mode("errorifexists").partitionBy("shard").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def require(problems: DataFrame, what: str) -> None:
    """Fails with the first of the rows that break a rule."""
    bad = problems.limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def ensured(df: DataFrame, rule: Column, what: str) -> DataFrame:
    """``df``, failing in the task that meets a row against the rule."""
    return df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def unsorted_rows(df: DataFrame, file: str, place: str, key: str) -> DataFrame:
    """Rows whose key does not come after that of the row before in their file."""
    return df.withColumn("before", F.lag(key).over(Window.partitionBy(file).orderBy(place))).where(F.col("before") >= F.col(key))


def tissue_mask(positions: DataFrame, width: int) -> DataFrame:
    """r, c, tissue of a position table that must name every cell of a square grid once, with flags 0 or 1."""
    p = positions.select("r", "c", "in_tissue")
    got = p.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("r", "c").alias("cells"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum((~F.col("in_tissue").isin(0, 1)).cast("long")).alias("odd")).first()
    if (got["rows"], got["cells"]) != (width * width, width * width) or (got["r0"], got["c0"], got["r1"], got["c1"]) != (0, 0, width - 1, width - 1):
        raise ValueError("positions do not cover the grid once")
    if got["odd"]:
        raise ValueError("tissue flags other than 0 and 1")
    return p.select("r", "c", (F.col("in_tissue") == 1).alias("tissue"))


def nuclei(mapping: DataFrame) -> DataFrame:
    """r, c, in_nucleus of a mapping; an unknown flag is false, and a cell must have one row."""
    require(repeated(mapping, "r", "c"), "a cell is mapped twice")
    return mapping.select("r", "c", F.coalesce("in_nucleus", F.lit(False)).alias("in_nucleus"))


def compartments(mapping: DataFrame) -> DataFrame:
    """r, c, state: 2 in a nucleus, 1 elsewhere in a cell, 0 outside; a nucleus must lie in a cell."""
    inside = ensured(mapping, ~F.coalesce("in_nucleus", F.lit(False)) | F.coalesce("in_cell", F.lit(False)), "a nucleus outside of cells")
    return inside.select("r", "c", F.when(F.col("in_nucleus"), 2).when(F.col("in_cell"), 1).otherwise(0).alias("state"))


def checked_weights(weights: DataFrame) -> DataFrame:
    """Weights per cell whose nucleus and cytoplasm must add up to the cell's."""
    return ensured(weights, F.abs(F.col("nucleus") + F.col("cytoplasm") - F.col("cell")) < 1e-12, "weights do not add up")


def roi_field(field: DataFrame, roi: DataFrame) -> DataFrame:
    """r, c, v of a sparse field inside a region of cells; masses must be positive and cells named once."""
    require(repeated(field, "unit_2um"), "a cell is named twice")
    _, r, c = parse_bin_id(F.col("unit_2um"))
    named = ensured(field, F.col("molecule_mass") > 0, "a mass is not positive").select(r.alias("r"), c.alias("c"), F.col("molecule_mass").alias("v"))
    return named.join(roi.select("r", "c").distinct(), ["r", "c"], "left_semi")


def _members(df: DataFrame) -> DataFrame:
    return df.withColumn("read_id", F.explode(F.split("member_read_ids", ";"))).drop("member_read_ids")


def open_reads(molecules: DataFrame, umi_mode: str, product: str) -> DataFrame:
    """A row per read of the molecules of one mode and product; a read must not be in two different ones."""
    reads = _members(molecules.where((F.col("umi_mode") == umi_mode) & (F.col("product") == product)))
    require(reads.groupBy("read_id").agg(F.countDistinct(F.struct("feature_id", "umi", "unit")).alias("molecules")).where("molecules > 1"), "a read in several molecules")
    return reads.select("read_id", "feature_id", "umi", "unit").distinct()


def product_reads(molecules: DataFrame, umi_mode: str) -> DataFrame:
    """read_id, product, unit of all products of one mode; a read must have one unit in a product."""
    reads = _members(molecules.where(F.col("umi_mode") == umi_mode)).select("read_id", "product", "unit").distinct()
    require(repeated(reads, "read_id", "product"), "a read with several units")
    return reads


def cliques(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """clique_id, candidates (by falling posterior, then cell) and reads; posteriors must sum to 1, a read is in one clique."""
    g = rows.groupBy("clique_id").agg(F.sum("posterior").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("posterior")).alias("low"), "r", "c"))).alias("all"), F.any_value("member_read_ids").alias("reads"))
    require(g.where(F.abs(F.col("total") - 1) > tolerance).select("clique_id", "total"), "posteriors do not sum to 1")
    out = g.select("clique_id", F.transform("all", lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), (-x["low"]).alias("p"))).alias("candidates"), F.split("reads", ";").alias("reads"))
    require(repeated(out.select("clique_id", F.explode("reads").alias("read_id")), "read_id"), "a read in several cliques")
    return out


def raw_candidates(rows: DataFrame) -> DataFrame:
    """read_id and its candidates; as many as each row declares, at different cells."""
    g = rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r", "c").alias("cells"), F.min("candidate_count").alias("lo"), F.max("candidate_count").alias("hi"), F.sort_array(F.collect_list(F.struct("r", "c", "e1", "e2"))).alias("candidates"))
    require(g.where("n <> lo or n <> hi or n <> cells").select("read_id", "n", "lo", "hi", "cells"), "candidates other than declared")
    return g.select("read_id", "candidates")


def vendor_molecules(reads: DataFrame) -> DataFrame:
    """Molecules (feature, UMI, unit) of the eligible reads of another method, with the digest of their reads; keys are unique."""
    require(repeated(reads, "read_id"), "a read twice")
    own = reads.where("eligible and feature_id is not null and unit is not null")
    return own.groupBy("feature_id", "umi", "unit").agg(F.count(F.lit(1)).alias("reads"), F.sort_array(F.collect_set("read_id")).alias("members"))


def hash_reads(ledger: DataFrame) -> DataFrame:
    """The reads that a ledger keeps, with their features; keys are unique and a kept read has a feature."""
    require(repeated(ledger, "read_id"), "a read twice")
    return ensured(ledger.where("action = 'keep'"), F.col("feature_id").isNotNull(), "a kept read without a feature").select("read_id", "feature_id")


def product_fields(molecules: DataFrame) -> DataFrame:
    """product, umi_mode, r, c, v: molecules of every product and mode by cell."""
    _, r, c = parse_bin_id(F.col("unit"))
    return molecules.select("product", "umi_mode", r.alias("r"), c.alias("c")).where("r is not null").groupBy("product", "umi_mode", "r", "c").agg(F.count(F.lit(1)).alias("v"))


def half_prior(rows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """half, idx, log_prior of a table of reads per half index: unique, not negative, both halves with equal sums."""
    require(repeated(rows, "half", "idx"), "an index twice")
    require(rows.where("reads < 0 or reads is null"), "negative reads")
    sums = {r["half"]: r["total"] for r in rows.groupBy("half").agg(F.sum("reads").alias("total")).collect()}  # two halves
    if len(set(sums.values())) > 1:
        raise ValueError(f"the halves have different sums: {sums}")
    return rows.select("half", "idx", F.ln(F.col("reads") + alpha).alias("log_prior"))


def factored_prior(cells: DataFrame, prior: DataFrame) -> DataFrame:
    """``cells`` (r, c) with the sum of the log priors of their halves, BC1 by column and BC2 by row."""
    half = lambda name, key: prior.where(F.col("half") == name).select(F.col("idx").alias(key), F.col("log_prior").alias(f"_{key}"))
    return cells.join(half("BC1", "c"), "c").join(half("BC2", "r"), "r").withColumn("log_prior", F.col("_c") + F.col("_r")).drop("_c", "_r")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sequence, quality of the records of four lines each; a record without @ and + at their places fails."""
    n = F.col("number") - 1
    lines = numbered_lines(spark, path).select("file", F.floor(n / 4).alias("record"), (n % 4).alias("k"), "value")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    # texts are summed up by sorting, so a task gets so many lines and not all of its files
    got = dealt(lines, "file", "record", rows=spark.read.text(path).count()).groupBy("file", "record").agg(line(0).alias("head"), line(1).alias("sequence"), line(2).alias("plus"), line(3).alias("quality"))
    sound = ensured(got, F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("sequence") == F.length("quality")), "not a FASTQ record")
    return sound.select(F.split(F.substr("head", F.lit(2)), " ")[0].alias("read_id"), "sequence", "quality")


def packed_records(spark: SparkSession, path: str, layout: str, names: list[str], header: int = 0) -> DataFrame:
    """Records of a fixed layout (as of struct) of binary files, with their file and number; whole numbers only."""
    size = struct.calcsize(layout)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                if (len(content) - header) % size:
                    raise ValueError(f"{file} is not a whole number of records")
                rows = list(struct.iter_unpack(layout, content[header:]))
                yield pd.DataFrame({"file": file, "number": np.arange(len(rows)), **{n: [r[k] for r in rows] for k, n in enumerate(names)}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, number long, " + ", ".join(f"{n} long" for n in names))


def first_records(records: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Of each wanted key the first record, by file and number."""
    own = records.join(wanted.select(key).distinct(), key, "left_semi")
    rest = [c for c in records.columns if c != key]
    return own.groupBy(key).agg(F.min(F.struct("file", "number", *(c for c in rest if c not in ("file", "number")))).alias("b")).select(key, *(F.col(f"b.{c}").alias(c) for c in rest if c not in ("file", "number")))


def read_grid(spark: SparkSession, path: str, key: str | None = None, width: int | None = None) -> DataFrame:
    """r, c, v of the cells above 0 of the numpy grids (.npy, or .npz with ``key``) under a path; flat ones need a width."""

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with io.BytesIO(content) as source:
                    loaded = np.load(source, allow_pickle=False)
                    grid = loaded[key] if key else loaded
                    grid = grid.reshape(-1, width) if width and grid.ndim == 1 else grid
                if grid.ndim != 2 or not np.isfinite(grid).all() or (grid < 0).any():
                    raise ValueError("a grid has two axes and finite values of at least 0")
                for top in range(0, len(grid), 256):
                    r, c = np.nonzero(grid[top : top + 256])
                    yield pd.DataFrame({"r": r + top, "c": c, "v": grid[top + r, c].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "r long, c long, v double")


def read_layout(spark: SparkSession, path: str, area: str) -> DataFrame:
    """The matrix of one area of layout files in JSON, a row per element."""
    schema = "areas array<struct<name:string,matrix:array<array<double>>>>"
    areas = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("areas").alias("a")).where(F.col("a.name") == area)
    return areas.select(F.posexplode("a.matrix").alias("i", "row")).select("i", F.posexplode("row").alias("j", "value"))

"""A store of candidate rows in buckets of (feature, UMI) groups, resolved without a shuffle, again only where it must be.

A bucket holds whole groups: its number is Spark's hash of feature and UMI. Rows are written once, clustered and sorted by
group, a file for each bucket, so work by group reads them where they lie, and other buckets' files are skipped by the
range of their bucket number. A manifest beside the rows has each bucket's
rows and a digest of its content that no order changes. Results keep the digest that they were made from: a later run
computes the buckets without a result, or whose content is another by now. A bucket whose rows are not those of its
manifest is found by counting again, and written anew alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["feature_id", "umi"]
MANIFEST = "bucket int, rows long, digest string"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def content(rows: DataFrame) -> DataFrame:
    """bucket, rows and digest: two sums of hashes of whole rows, which equal rows change as often as they occur."""
    columns = sorted(c for c in rows.columns if c != "bucket")
    text = F.to_json(F.struct(*columns))
    sums = [F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(20,0)")) for seed in (1, 2)]
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


class CandidateStore:
    """The store at ``path``, a folder that all executors share, of ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"tessera_store_{uuid.uuid4().hex}"

    def bucket(self) -> Column:
        return F.pmod(F.hash(*GROUP), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket()).repartition(self.buckets, *GROUP)

    def write(self, rows: DataFrame) -> None:
        """Writes all rows; one shuffle, the only one that they take."""
        placed = self._placed(rows)
        placed.write.bucketBy(self.buckets, *GROUP).sortBy(*GROUP).option("path", f"{self.path}/rows").mode("overwrite").saveAsTable(self.name)
        content(self.rows()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")  # a row per bucket

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets alone if wanted."""
        if not self.spark.catalog.tableExists(self.name):
            schema = self.spark.read.parquet(f"{self.path}/rows").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({', '.join(GROUP)}) SORTED BY ({', '.join(GROUP)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        found = self.spark.table(self.name)
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def forget(self) -> None:
        """Takes the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def missing(self, out: str) -> list[int]:
        """Buckets with rows and without a result in ``out`` that was made from just these rows."""
        wanted = self.manifest().select("bucket", "digest")
        if _exists(self.spark, f"{out}/manifest"):
            done = self.spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
            wanted = wanted.join(done.select("bucket", "digest"), ["bucket", "digest"], "left_anti")
        return sorted(r.bucket for r in wanted.select("bucket").collect())  # as many as there are buckets

    def resolve(self, work: Callable[[DataFrame], DataFrame], out: str) -> list[int]:
        """Applies ``work`` to the missing buckets, and writes what it gives (with bucket) in ``out``, a folder per bucket; returns
        the buckets. Results are there before they count as done, and a repeated run replaces them whole."""
        todo = self.missing(out)
        if todo:
            # a bucket whose work gives no row must lose an older result too
            for k in todo:
                at, fs = _file_system(self.spark, f"{out}/data/bucket={k}")
                fs.delete(at, True)
            work(self.rows(todo)).write.partitionBy("bucket").mode("append").parquet(f"{out}/data")
            self.manifest().where(F.col("bucket").isin(todo)).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
        return todo

    def broken(self) -> list[int]:
        """Buckets whose rows are not those of the manifest."""
        now = content(self.rows()).select("bucket", F.col("digest").alias("now"))
        met = self.manifest().join(now, "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("now")))
        return sorted(r.bucket for r in met.select("bucket").collect())

    def repair(self, source: DataFrame, buckets: list[int] | None = None) -> list[int]:
        """Writes the broken buckets, or those given, anew from ``source``, all rows as :meth:`write` takes them; the others'
        files stay as they are. Their content, and so their results, count as new only if it is another."""
        todo = self.broken() if buckets is None else sorted(buckets)
        if todo:
            at, fs = _file_system(self.spark, f"{self.path}/rows")
            for status in fs.listStatus(at):
                tail = status.getPath().getName().rsplit("_", 1)[-1].split(".")[0]
                if tail.isdigit() and int(tail) in todo:  # files end with the number of their bucket
                    fs.delete(status.getPath(), False)
            self.spark.catalog.refreshTable(self.name)
            self._placed(source.withColumn("bucket", self.bucket()).where(F.col("bucket").isin(todo)).drop("bucket")).write.bucketBy(self.buckets, *GROUP).sortBy(*GROUP).option("path", f"{self.path}/rows").mode("append").saveAsTable(self.name)
            rest = self.manifest().where(~F.col("bucket").isin(todo)).collect()  # a row per bucket
            fresh = content(self.rows(todo)).collect()
            self.spark.createDataFrame([tuple(r) for r in rest + fresh], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        return todo


def read_posteriors(rows: DataFrame) -> DataFrame:
    """Candidates with the softmax p of their likelihoods within each read; no shuffle where rows lie in buckets."""
    own = F.max("ll").over(_window())
    scored = rows.withColumn("e", F.exp(F.col("ll") - own))
    return scored.withColumn("p", F.col("e") / F.sum("e").over(_window())).drop("e")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy(*GROUP, "read_id")


def group_calls(rows: DataFrame) -> DataFrame:
    """bucket, feature_id, umi, candidate, reads and expected: what each group's reads say of each candidate, 1 - prod(1 - p)."""
    p = read_posteriors(rows)
    return p.groupBy("bucket", *GROUP, "candidate").agg(F.count(F.lit(1)).alias("reads"), F.sum("p").alias("mass"), (1 - F.product(1 - F.col("p"))).alias("expected"))

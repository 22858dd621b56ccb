"""Matrices, fields, masks, reads and molecules made from the given tables, in Spark and in SQL."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid

#: Features, and the least side of the grid, that the tables' keys are dealt on. The side grows with the root of the items, so
#: that a cell has the same number of them at any size.
FEATURES, SIDE, PER_CELL = 50, 64, 16

PRELUDE = """
WITH RECURSIVE side AS (SELECT cast(greatest(64, 8 * ceil(sqrt(count(*) / 16.0) / 8)) AS bigint) AS s FROM lineitem),
obs AS (SELECT l_partkey % 50 AS feature_id, l_orderkey % (SELECT s FROM side) AS r, l_suppkey % (SELECT s FROM side) AS c, l_quantity AS v, l_returnflag AS m FROM lineitem),
ma AS (SELECT feature_id, r, c, sum(v) AS v FROM obs WHERE m = 'A' GROUP BY ALL),
mb AS (SELECT feature_id, r, c, sum(v) AS v FROM obs WHERE m = 'R' GROUP BY ALL),
mp AS (SELECT feature_id, r, c, sum(v) AS v FROM obs WHERE m IN ('A', 'R') GROUP BY ALL),
field AS (SELECT r, c, sum(v) AS v FROM obs GROUP BY ALL),
mask AS (SELECT i // s AS r, i % s AS c, ((i // s) * 7 + (i % s) * 13) % 11 < 4 AS inside, ((i // s) + (i % s)) % 9 > 0 AS support FROM (SELECT unnest(range(s * s)) AS i, s FROM side)),
dense AS (SELECT mask.r, mask.c, inside, support, coalesce(v, 0) AS v FROM mask LEFT JOIN field ON field.r = mask.r AND field.c = mask.c),
al AS (SELECT coalesce(ma.feature_id, mb.feature_id) AS feature_id, coalesce(ma.r, mb.r) AS r, coalesce(ma.c, mb.c) AS c, coalesce(ma.v, 0) AS a, coalesce(mb.v, 0) AS b
  FROM ma FULL OUTER JOIN mb ON ma.feature_id = mb.feature_id AND ma.r = mb.r AND ma.c = mb.c),
cand AS (SELECT cast(event_id AS varchar) AS read_id, event_type AS feature_id,
  substr('ACGT', ((user_id % 97) // 64) % 4 + 1, 1) || substr('ACGT', ((user_id % 97) // 16) % 4 + 1, 1) || substr('ACGT', ((user_id % 97) // 4) % 4 + 1, 1) || substr('ACGT', (user_id % 97) % 4 + 1, 1) AS umi,
  (event_id * 7 + k * 5) % 4 AS r, (event_id * 11 + k * 3) % 4 AS c, -((event_id * 13 + k * 7) % 10) / 4.0 AS ll
  FROM events, range(3) t(k) WHERE k <= event_id % 3),
post AS (SELECT read_id, feature_id, umi, 's_002um_' || r || '_' || c AS candidate, r, c, exp(ll - max(ll) OVER w) / sum(exp(ll)) OVER w * exp(max(ll) OVER w) AS p FROM cand WINDOW w AS (PARTITION BY read_id)),
mol_a AS (SELECT cast(o_custkey AS varchar) AS molecule, o_orderkey AS read FROM orders),
mol_b AS (SELECT o_custkey || '-' || o_orderstatus AS molecule, o_orderkey AS read FROM orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """The views of one data directory; each is a plan, nothing is computed here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.features = spark, sf_dir, FEATURES

    @cached_property
    def side(self) -> int:
        rows = self.table("lineitem").count()  # from the files' footers
        return max(SIDE, 8 * math.ceil(math.sqrt(rows / PER_CELL) / 8))

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def obs(self) -> DataFrame:
        key = lambda c, n: F.pmod(F.col(c), F.lit(n))
        return self.table("lineitem").select(key("l_partkey", FEATURES).alias("feature_id"), key("l_orderkey", self.side).alias("r"), key("l_suppkey", self.side).alias("c"), F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("m"))

    def matrix(self, *flags: str) -> DataFrame:
        return self.obs().where(F.col("m").isin(*flags)).groupBy("feature_id", "r", "c").agg(F.sum("v").alias("v"))

    def field(self) -> DataFrame:
        return self.obs().groupBy("r", "c").agg(F.sum("v").alias("v"))

    def mask(self) -> DataFrame:
        g = grid.dense_grid(self.spark, self.side, self.side)
        return g.withColumn("inside", (F.col("r") * 7 + F.col("c") * 13) % 11 < 4).withColumn("support", (F.col("r") + F.col("c")) % 9 > 0)

    def dense(self) -> DataFrame:
        return self.mask().join(self.field(), ["r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))

    def candidates(self) -> DataFrame:
        u = F.pmod(F.col("user_id"), F.lit(97))
        letter = lambda d: F.substr(F.lit("ACGT"), (F.floor(u / d) % 4 + 1).cast("int"), F.lit(1))
        e = self.table("events").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)))
        r, c = (F.col("event_id") * 7 + F.col("k") * 5) % 4, (F.col("event_id") * 11 + F.col("k") * 3) % 4
        return e.select(
            F.col("event_id").cast("string").alias("read_id"), F.col("event_type").alias("feature_id"), F.concat(*(letter(d) for d in (64, 16, 4, 1))).alias("umi"),
            r.alias("r"), c.alias("c"), grid.bin_id(2, r, c).alias("candidate"), (-((F.col("event_id") * 13 + F.col("k") * 7) % 10) / 4.0).alias("ll"),
        )

    def wide_candidates(self) -> DataFrame:
        """Candidates on the whole grid, of groups that grow with the events: read_id, feature_id, umi, candidate, ll."""
        e = self.table("events").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)))
        r, c = (F.col("event_id") * 7 + F.col("k") * 5) % self.side, (F.col("event_id") * 11 + F.col("k") * 3) % self.side
        feature, umi = F.concat("event_type", F.lit("-"), (F.col("event_id") % 40).cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 4096).cast("string"))
        return e.select(F.col("event_id").cast("string").alias("read_id"), feature.alias("feature_id"), umi.alias("umi"), grid.bin_id(2, r, c).alias("candidate"), (-((F.col("event_id") * 13 + F.col("k") * 7) % 10) / 4.0).alias("ll"))

    def posteriors(self) -> DataFrame:
        """Every read as a clique of its own."""
        from pyspark.sql import Window

        w = Window.partitionBy("read_id")
        e = self.candidates().withColumn("e", F.exp(F.col("ll") - F.max("ll").over(w)))
        return e.withColumn("p", F.col("e") / F.sum("e").over(w)).withColumn("clique_key", F.col("read_id")).drop("e", "ll")

    def molecules(self, method: str) -> DataFrame:
        o = self.table("orders")
        name = F.col("o_custkey").cast("string") if method == "a" else F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderstatus"))
        return o.select(name.alias("molecule"), F.col("o_orderkey").alias("read"))

"""The decoded assignment ledger: its typed columns, reading, derived names and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import bin_id

#: Columns of a ledger and their types, in file order.
COLUMNS = """
assignment_group_id string
candidate_index int
candidate_count int
feature_id string
feature_name string
umi string
row2 int
col2 int
unit_2um_id string
unit_8um_id string
unit_16um_id string
sequence_status string
sequence_score double
sequence_rank int
score0 double
score1 double
score2 double
score3 double
posterior_weight double
resolver string
resolver_version string
resolver_margin double
source string
read_id string
raw_bc_sequence string
bc1_edit int
bc2_edit int
anchor_score int
offset_sum int
full_start int
bc1_obs_len int
bc2_obs_len int
same_parent_8um boolean
same_parent_16um boolean
cell_id string
region_id string
"""
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
SCHEMA = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (line.split() for line in COLUMNS.strip().splitlines())])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).option("sep", "\t").option("nullValue", "").option("mode", "FAILFAST").csv(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.select(*SCHEMA.names).write.mode("errorifexists").option("header", True).option("sep", "\t").option("nullValue", "").csv(path)


def with_units(ledger: DataFrame) -> DataFrame:
    """Unit names from the coordinates where they are not given."""
    known = F.col("row2").isNotNull() & F.col("col2").isNotNull()
    name = lambda s: F.coalesce(F.col(f"unit_{s}um_id"), F.when(known, bin_id(s, F.col("row2"), F.col("col2"))))
    return ledger.withColumns({f"unit_{s}um_id": name(s) for s in (2, 8, 16)})


def with_parent_flags(ledger: DataFrame) -> DataFrame:
    """Whether a group's named parents agree at 8 and 16 um."""
    flags = ledger.groupBy("assignment_group_id").agg(*(((F.min(f"unit_{s}um_id") == F.max(f"unit_{s}um_id")).alias(f"_same_{s}")) for s in (8, 16)))
    met = ledger.join(flags, "assignment_group_id")
    return met.withColumns({f"same_parent_{s}um": F.col(f"_same_{s}") for s in (8, 16)}).drop("_same_8", "_same_16")


def violations(ledger: DataFrame) -> DataFrame:
    """assignment_group_id and the first rule that the group or one of its rows breaks; no row for a sound ledger."""
    row = F.when(F.col("candidate_index") < 0, "negative index").when(~F.col("posterior_weight").between(0, 1), "weight outside 0 to 1")
    row = row.when((F.col("row2") < 0) | (F.col("col2") < 0), "negative coordinate").when((F.col("sequence_status") == "unique") & (F.col("candidate_count") != 1), "unique with candidates")
    g = ledger.groupBy("assignment_group_id").agg(
        F.min(row).alias("bad"), F.count(F.lit(1)).alias("n"), F.min("candidate_count").alias("lo"), F.max("candidate_count").alias("hi"),
        F.countDistinct("candidate_index").alias("d"), F.min("candidate_index").alias("first"), F.max("candidate_index").alias("last"),
    )
    group = F.when(F.col("lo") != F.col("hi"), "counts differ").when(F.col("n") != F.col("lo"), "count is not the size").when((F.col("d") != F.col("n")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "indices are not 0 to n - 1")
    return g.select("assignment_group_id", F.coalesce("bad", group).alias("violation")).where("violation is not null")

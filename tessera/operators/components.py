"""Connected components of a table of edges by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, dealt


def _comes_first(a: Column, b: Column) -> Column:
    """Whether ``a`` is before ``b`` in the order of hashes; a random order keeps chains from shrinking one by one."""
    x, y = F.xxhash64(a), F.xxhash64(b)
    return (x < y) | ((x == y) & (a < b))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the smallest node that it reaches.

    In a round each node moves to its first neighbour, if that is before itself, and edges move with their ends; those within
    one node go. A round takes away a share of the nodes of any graph, so paths of any length need few rounds. Each round
    ends in a checkpoint.

    A round keeps only where the nodes that it still has move to. Least nodes are carried up these moves and labels down them
    again, so each join and sum is of a round's nodes and not of all that a few roots have gathered. Moves and least nodes are
    plain columns, for which Spark sums by hash and sorts nothing. Numbers compress too well for what is sent to tell how much
    a task will hold, so rows are dealt by their count."""
    a, b = F.col("a"), F.col("b")

    def ordered(e: DataFrame) -> DataFrame:
        ahead = _comes_first(a, b)
        return e.where("a <> b").select(F.when(ahead, a).otherwise(b).alias("a"), F.when(ahead, b).otherwise(a).alias("b"))

    def distinct(e: DataFrame, rows: int) -> DataFrame:
        return cut(dealt(e, *e.columns, rows=rows).distinct())

    own = cut(edges.select("a", "b"))
    size = own.count()  # here and below from the files' footers
    nodes = distinct(own.select(a.alias("node")).unionByName(own.select(b.alias("node"))), 2 * size).withColumn("least", F.col("node"))
    live = distinct(ordered(own), size)
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        size = live.count()
        # an edge is stored from its first end to the other, so only the other one has a neighbour before it
        to = cut(dealt(live, "b", rows=size).groupBy(b.alias("node")).agg(F.min_by(a, F.xxhash64(a)).alias("to")))
        placed = cut(dealt(nodes, "node", rows=nodes.count()).join(to, "node", "left").withColumn("to", F.coalesce("to", "node")))
        rounds.append(placed.select("node", "to"))
        nodes = cut(placed.groupBy(F.col("to").alias("node")).agg(F.min("least").alias("least")))
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = dealt(dealt(live, "a", rows=size).join(left, "a", "left"), "b", rows=size).join(right, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        live = distinct(ordered(moved), size)
    labels = nodes.select("node", F.col("least").alias("label"))
    for placed in reversed(rounds):
        labels = cut(dealt(placed, "to", rows=placed.count()).join(labels.withColumnRenamed("node", "to"), "to").select("node", "label"))
    return labels

"""Connected components of a table of edges by contraction: nodes follow their first neighbour, and edges follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import discard, keep


def _first(a: Column, b: Column) -> Column:
    """Of two nodes the one with the smaller hash; a random order keeps chains from falling one by one."""
    x, y = F.xxhash64(a), F.xxhash64(b)
    return (x < y) | ((x == y) & (a < b))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the smallest node that it reaches.

    Every round each node follows its first neighbour, if that comes before it, edges are renamed so, and those within
    one node go, so the edges shrink by a factor. Every round's tables are written."""
    a, b = F.col("a"), F.col("b")

    def directed(e: DataFrame) -> DataFrame:
        ahead = _first(a, b)
        return e.where("a <> b").select(F.when(ahead, a).otherwise(b).alias("a"), F.when(ahead, b).otherwise(a).alias("b")).distinct()

    live, labels = keep(directed(edges.select("a", "b")), "edges"), None
    for _ in range(most_rounds):
        low = F.struct(F.xxhash64("low").alias("h"), "low")
        ends = live.select(b.alias("node"), a.alias("low")).unionByName(live.select(a.alias("node"), a.alias("low")))
        follow = keep(ends.groupBy("node").agg(F.min(low).getField("low").alias("to")), "follow")
        step = follow.select(F.col("node").alias("root"), "to")
        moved = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")) if labels is not None else follow.select("node", F.col("to").alias("root"))
        before, labels = labels, keep(moved, "labels")
        if before is not None:
            discard(before)
        renamed = live.join(follow.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(follow.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        before, live = live, keep(directed(renamed.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
        discard(before)
        discard(follow)
        if live.isEmpty():
            discard(live)
            least = labels.groupBy("root").agg(F.min("node").alias("label"))
            return labels.join(least, "root").select("node", "label")
    raise RuntimeError("labels did not settle")

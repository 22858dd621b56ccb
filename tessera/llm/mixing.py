"""Mixing sources to target weights by pivotal rounding, with DataFrame functions alone.

A source's target divided by its size is the number of copies each of its documents should have on average. The whole
part is given to all; the fractional parts are rounded by the pivotal method: two documents exchange mass, measured in
words, in a random direction until one of them has none or all of its own. The expected copies of each stay as they
were and the pair's words stay the same. Documents meet in small buckets of one source; long documents come first and what a bucket leaves
undecided, one document, meets the leavings of other buckets on the next level of a tree, and the very last goes
to the nearer side, so the source's words end within half a document of its target. Random numbers are hashes of the ids that meet, so reruns agree.

Equal rows (one source, id and text) are counted first: as exchanging mass among them leaves one fraction at most, so many of
them as their fractions sum to are rounded up and one document with the rest of the sum takes part. Buckets are as many as
a source's documents need, so a source that holds a third of all rows has its own many, and no bucket is of equal rows.

Defined cases: a null or empty text has size 0 and takes nothing; null is a source of its own, the last; repeated rows
are documents of their own; a table without words has all targets 0; an empty table gives no rows. Only doc_id, text and
source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import fresh, keep, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of a bucket, on average.
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, source and the number of words."""
    return docs.select(F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs and target, one row per source.

    Targets are in proportion to the weights, but at most ``most`` times the source's size: the level at which all is
    shared is found by ordering sources by that limit over their weight. The windows hold a row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("most", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(everything) - below) / left
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    return leveled.withColumn("final", F.max(fits).over(everything)).select("source", "source_size", "n_docs", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


def _meet(level: int):
    """One step of the fold: the document in hand meets the next; the one that becomes integral is done."""

    def step(acc: Column, x: Column) -> Column:
        gain = F.least(acc["size"] - acc["mass"], x["mass"])
        loss = F.least(acc["mass"], x["size"] - x["mass"])

        def after(t: Column) -> Column:
            up = t["u"] * (t["gain"] + t["loss"]) < t["loss"]
            moved = F.when(up, t["gain"]).otherwise(-t["loss"])
            mine, other = acc["mass"] + moved, x["mass"] - moved
            whole = (mine <= 0) | (mine >= acc["size"])
            ended = F.when(whole, F.struct(acc["row"].alias("row"), (mine > 0).alias("pick"))).otherwise(F.struct(x["row"].alias("row"), (other > 0).alias("pick")))
            return F.struct(
                F.concat(acc["done"], F.array(ended)).alias("done"),
                F.when(whole, x["row"]).otherwise(acc["row"]).alias("row"),
                F.when(whole, x["size"]).otherwise(acc["size"]).alias("size"),
                F.when(whole, other).otherwise(mine).alias("mass"),
            )

        drawn = F.struct(gain.alias("gain"), loss.alias("loss"), _uniform(acc["row"], x["row"], F.lit(level)).alias("u"))
        return F.transform(F.array(drawn), after)[0]

    return step


def _round_level(rows: DataFrame, level: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Rounds inside buckets: the decided rows, and one undecided row per bucket."""
    buckets = F.ceil(F.col("n") / fan).cast("long")
    grouped = rows.groupBy("source", F.pmod(F.xxhash64("row", F.lit(level)), F.greatest(buckets, F.lit(1))).alias("bucket"), F.greatest(buckets, F.lit(1)).alias("n"))
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("large"), F.xxhash64("row").alias("order"), "row", "size", "mass"))).alias("all"))
    head = F.col("all")[0]
    start = F.struct(F.expr("cast(array() as array<struct<row:struct<doc_id:bigint,mark:bigint,size:bigint,rows:bigint>,pick:boolean>>)").alias("done"), head["row"].alias("row"), head["size"].alias("size"), head["mass"].alias("mass"))
    folded = listed.select("source", "n", F.aggregate(F.slice("all", 2, F.size("all")), start, _meet(level)).alias("f"))
    folded = keep(folded, "mix")
    done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.row", "d.pick")
    rest = folded.select("source", F.col("f.row").alias("row"), F.col("f.size").alias("size"), F.col("f.mass").alias("mass"), "n")
    return done, rest


#: Shares of copies nearer to a whole number than this are whole.
NEAR = 1e-9


def mix(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, mark (a hash of the text), source, size, source_size, target, copies and taken, one row per document row."""
    sized = keep(sizes(docs), "sizes")
    goal = keep(targets(sized), "targets")
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.rint(ratio)
    ratio = F.when(F.abs(ratio - near) < 1e-12, near).otherwise(ratio)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)).withColumnRenamed("source", "_source")
    equal = sized.groupBy("source", "doc_id", "mark", "size").agg(F.count(F.lit(1)).alias("rows"))
    joined = equal.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ups = F.when(F.col("size") > 0, F.floor(F.col("rows") * F.col("part") + NEAR)).otherwise(F.lit(0))  # equal rows that are rounded up
    left = F.col("rows") * F.col("part") - ups
    moving = (left > NEAR) & (F.col("size") > 0)
    row = F.struct("doc_id", "mark", "size", "rows").alias("row")
    rows = joined.where(moving).select("source", row, F.col("size").cast("double").alias("size"), (left * F.col("size")).alias("mass"), F.col("n_docs").alias("n"))
    decided = joined.where(~moving).select("source", row, F.lit(False).alias("pick"))
    level, n = 0, most
    while n > 1 or level == 0:
        done, rows = _round_level(rows, level, fan)
        decided, level, n = decided.unionByName(done), level + 1, -(-n // fan)
    last = rows.select("source", "row", (2 * F.col("mass") >= F.col("size")).alias("pick"))
    every = decided.unionByName(last).select("source", "row.*", "pick").join(goal, F.col("source").eqNullSafe(F.col("_source")))
    more = ups + F.col("pick").cast("long")
    each = every.select("*", more.alias("more"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("number"))
    copies = (F.col("whole") + (F.col("number") <= F.col("more")).cast("long")).cast("long")
    return each.select("doc_id", "mark", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    id_, mark, src, total, rows, number = (fresh(x, docs.columns) for x in ("id", "mark", "src", "total", "rows", "number"))
    taken = mix(docs, fan).groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("source").alias(src))
    taken = keep(taken.agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).where(F.col(total) > 0), "mixed")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(mark)) & F.col("source").cast("string").eqNullSafe(F.col(src))
    alone = docs.join(taken.where(F.col(rows) == 1), same)
    # equal rows share their copies: all have the same number, and the first ones one more
    equal = docs.join(taken.where(F.col(rows) > 1), same).withColumn(number, F.row_number().over(Window.partitionBy(id_, mark, src).orderBy(F.lit(0))))
    equal = equal.withColumn(total, F.floor(F.col(total) / F.col(rows)) + (F.col(number) <= F.col(total) % F.col(rows)).cast("long"))
    both = alone.select(*docs.columns, total).unionByName(equal.select(*docs.columns, total))
    return both.withColumn(number, F.explode(F.array_repeat(F.lit(0), F.col(total).cast("int")))).select(docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")

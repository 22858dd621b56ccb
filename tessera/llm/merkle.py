"""Merkle manifest of a dataset: a tree of digests for each group of rows and one over the groups, with proofs.

Every row is a leaf, the digest of its columns. The leaves of a group ascend by their order columns; every ``fanout``
consecutive nodes have a parent, level by level, until one node remains, the group's subroot. Subroots, ordered by group,
make a tree in the same way, whose last node is the root.

A level is a pivot over slots: conditional aggregates spread the children of each parent into ``fanout`` columns, which
concatenated give the parent's digest; leaving out the column of one's own slot leaves the siblings. Paths are handed
down from the root, a level at a time: each parent's row gives its children their siblings and its own path. So a level
is an aggregate up and a join down over an eighth of the rows of the level below.

A row's place in its group comes from a range partitioning by group and order: a partition holds a run of places, so
only the partitions' row counts are added up and no task holds a group.

Defined cases: a null in a column reads ``-`` and an empty text ``0:``; a null group comes first and is no other; a null
order value comes first; rows of equal order are ordered by their digest, so repeated rows have places of their own; a
group of one row has its leaf as subroot, and a single group its subroot as root; an empty table gives no rows. Columns
of other names are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import finished, keep, table

FANOUT = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<l string, r string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex of the SHA-256 of the parts one after the other; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return digest(*(field(c) for c in columns))


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows``, kept, with ``pos``, the place of each in its group from 0, and ``size``, the rows of the group.

    Row numbers of a range partition rise with its order, so a place is the row's number within its part of the group
    beside the rows of the parts before."""
    by = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "placed")
    parts = dealt.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)  # a row per partition that holds some of the group
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    return keep(dealt.join(offsets, ["_part", group]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"), "leaves")


def _slots(fanout: int) -> list[str]:
    return [f"slot{j}" for j in range(fanout)]


def levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, with up (the parent's place), a column per slot, the parent's digest and left
    (nodes of the level in the group); and the digest that each group ends with.

    ``nodes`` has grp, pos, digest and left. A level has an eighth of the rows of the level below."""
    most = nodes.agg(F.max("left")).first()[0] or 0
    found, tops = [], [nodes.where("left = 1").select("grp", "digest")]
    while most > 1:
        pivot = [F.max(F.when(F.col("pos") % fanout == j, F.col("digest"))).alias(s) for j, s in enumerate(_slots(fanout))]
        runs = nodes.where("left > 1").groupBy("grp", F.expr(f"pos div {fanout}").alias("up")).agg(*pivot, F.max("left").alias("left"))
        runs = keep(runs.withColumn("digest", digest(*map(F.col, _slots(fanout)))), "runs")
        found.append(runs)
        nodes = runs.select("grp", F.col("up").alias("pos"), "digest", F.expr(f"(left + {fanout - 1}) div {fanout}").alias("left"))
        tops.append(nodes.where("left = 1").select("grp", "digest"))
        most = -(-most // fanout)
    ends = tops[0]
    for t in tops[1:]:
        ends = ends.unionByName(t)
    return found, keep(ends, "ends")


def siblings(slot: int, fanout: int) -> Column:
    """The other slots' columns: those to the left and those to the right."""
    names = _slots(fanout)
    return F.struct(F.concat_ws("", *names[:slot]).alias("l"), F.concat_ws("", *names[slot + 1 :]).alias("r"))


def handed_down(found: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame | None:
    """The lowest runs, each with the path from its parent to the root and what else ``tops`` (grp, path, ...) has for its group."""
    above = None
    more = [c for c in tops.columns if c not in ("grp", "path")]
    for runs in reversed(found):
        met = runs.where(f"left <= {fanout}").join(tops, "grp")  # one run of a group is its last
        if above is not None:
            met = met.unionByName(runs.where(f"left > {fanout}").join(above, ["grp", "up"]))
        if runs is found[0]:
            return met
        slots = [F.when(F.col(s).isNotNull(), F.struct(F.lit(j).cast("long").alias("slot"), siblings(j, fanout).alias("own"))) for j, s in enumerate(_slots(fanout))]
        children = met.select("grp", "up", "path", *more, F.explode(F.array_compact(F.array(*slots))).alias("x"))
        above = keep(children.select("grp", (F.col("up") * fanout + F.col("x.slot")).alias("up"), F.concat(F.array("x.own"), "path").alias("path"), *more), "paths")
    return None


def leaf_paths(leaves: DataFrame, found: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (grp, pos, left, ...) with the path of each to the root: its siblings at every level, lowest first."""
    alone = leaves.where("left = 1").join(tops, "grp")
    runs = handed_down(found, tops, fanout)
    if runs is None:
        return alone
    slot = F.col("pos") % fanout
    own = siblings(fanout - 1, fanout)
    for j in reversed(range(fanout - 1)):
        own = F.when(slot == j, siblings(j, fanout)).otherwise(own)
    met = leaves.where("left > 1").withColumn("up", F.expr(f"pos div {fanout}")).join(runs.drop("left", "digest"), ["grp", "up"])
    return met.withColumn("path", F.concat(F.array(own), "path")).drop("up", *_slots(fanout)).unionByName(alone)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, fanout: int = FANOUT) -> DataFrame:
    """``rows`` with subroot, root and path of each. ``leaf`` names the column of digests; ``rows`` must not have columns
    grp, pos, size, left, digest, up, path or slotN of its own, nor names that begin with an underscore."""
    grouped = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    leaves = placed(grouped, "grp", [*order, leaf]).withColumnRenamed("size", "left")
    nodes = leaves.select("grp", "pos", F.col(leaf).alias("digest"), "left")
    found, subroots = levels(nodes, fanout)
    # the same over the subroots, as one group
    named = placed(subroots.select(F.lit(0).alias("all"), "grp", "digest"), "all", ["grp"])
    heads = named.select(F.col("all").alias("grp"), "pos", "digest", F.col("size").alias("left"), F.col("grp").alias("of"))
    upper, root = levels(heads.drop("of"), fanout)
    top = root.select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = leaf_paths(heads, upper, top, fanout).select(F.col("of").alias("grp"), "path", "root", F.col("digest").alias("subroot"))
    return leaf_paths(leaves, found, keep(tops, "tops"), fanout)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    columns = lambda t: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    leaf = leaf_digest(columns(text))
    changed = F.when(chosen & (lowered != text), leaf_digest(columns(lowered)))
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), changed.alias("changed"))

    def proofs() -> DataFrame:
        got = manifest(rows, "lang", ["doc_id"], "leaf")
        out = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))

    return finished("manifest", proofs)


OP13_SQL = """
WITH RECURSIVE
steps AS (  -- the table of CRC-32, eight shifts for each byte
    SELECT i AS byte, 0 AS k, i::UBIGINT AS v FROM range(256) t(i)
    UNION ALL
    SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
docs AS (
    SELECT d.*, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 3 = 0 AS chosen
    FROM documents d, crc
),
fields AS (
    SELECT doc_id, lang, chosen, text, low,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM docs
),
leaves AS (
    SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN coalesce(chosen, false) THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed FROM fields)
),
nodes AS (
    SELECT 0 AS k, lang, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT k + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY k, lang, pos // 8
),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS k, pos, h, n FROM subroots
    UNION ALL
    SELECT k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY k, pos // 8
),
lower_sides AS (
    SELECT a.k, a.lang, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM nodes a JOIN nodes b ON a.k = b.k AND a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.k, a.lang, a.pos
),
upper_sides AS (
    SELECT a.k, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM tops a JOIN tops b ON a.k = b.k AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.k, a.pos
),
low_walk AS (
    SELECT doc_id, lang, leaf, 0 AS k, pos, n, '' AS proof, coalesce(changed, leaf) AS cur FROM leaves
    UNION ALL
    SELECT w.doc_id, w.lang, w.leaf, w.k + 1, w.pos // 8, (w.n + 7) // 8, w.proof || s.l || s.r, sha256(s.l || w.cur || s.r)
    FROM low_walk w JOIN lower_sides s ON s.k = w.k AND s.lang IS NOT DISTINCT FROM w.lang AND s.pos = w.pos WHERE w.n > 1
),
walk AS (
    SELECT doc_id, leaf, s.h AS subroot, 0 AS k, s.pos, s.n, proof, cur FROM low_walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL
    SELECT w.doc_id, w.leaf, w.subroot, w.k + 1, w.pos // 8, (w.n + 7) // 8, w.proof || s.l || s.r, sha256(s.l || w.cur || s.r)
    FROM walk w JOIN upper_sides s ON s.k = w.k AND s.pos = w.pos WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
FROM walk w, (SELECT h FROM tops WHERE n = 1) t WHERE w.n = 1
"""

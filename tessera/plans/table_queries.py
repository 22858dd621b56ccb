"""Queries that group, pivot, compare and audit result tables."""

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, dealt
from ..operators.exact import quantiles
from .registry import query
from .views import Views


def _slides(v: Views):
    s, n, r = v.table("supplier"), v.table("nation"), v.table("region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name", F.col("s_acctbal").alias("x"))


_SLIDES = "WITH s AS (SELECT s_suppkey, n_name, r_name, s_acctbal AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


@query("qc_grouped", _SLIDES + """
SELECT r_name, n_name, cast(count(*) AS bigint) AS n, round(quantile_cont(x, 0.5), 4) AS median, min(x) AS least, max(x) AS most, CASE WHEN count(*) >= 5 THEN round(avg(x), 4) END AS mean, CASE WHEN count(*) >= 5 THEN round(stddev_samp(x), 4) END AS sd FROM s GROUP BY GROUPING SETS ((r_name), (r_name, n_name))
""", prelude=False)
def qc_grouped(v: Views):
    d = _slides(v)
    enough = lambda x: F.when(F.count(F.lit(1)) >= 5, F.round(x, 4))
    aggs = [F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), enough(F.avg("x")).alias("mean"), enough(F.stddev_samp("x")).alias("sd")]
    got = d.rollup("r_name", "n_name").agg(F.grouping_id().alias("g"), *aggs).where("g < 3").drop("g")
    levels = d.withColumn("n_name", F.explode(F.array("n_name", F.lit(None).cast("string"))))
    half = quantiles(levels, ["r_name", "n_name"], "x", m=0.5).select(F.col("r_name").alias("_r"), F.col("n_name").alias("_n"), F.round("m", 4).alias("median"))
    return got.join(half, (F.col("r_name") == F.col("_r")) & F.col("n_name").eqNullSafe(F.col("_n"))).drop("_r", "_n")


@query("qc_leave_one_out", _SLIDES + """
, o AS (SELECT a.s_suppkey, a.r_name, a.x, count(b.x) AS others, min(b.x) AS lo, max(b.x) AS hi FROM s a LEFT JOIN s b ON a.r_name = b.r_name AND a.s_suppkey <> b.s_suppkey GROUP BY ALL)
SELECT s_suppkey, r_name, cast(others AS bigint) AS others, CASE WHEN others < 5 THEN NULL WHEN x < lo OR x > hi THEN 'outside' ELSE 'inside' END AS flag FROM o
""", prelude=False)
def qc_leave_one_out(v: Views):
    """Flag of each row against the range of the others of its group, from the group's two smallest and largest values."""
    d = _slides(v)
    pair = F.struct("x", "s_suppkey")
    ends = d.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    met = d.join(ends, "r_name")
    inner = met.where((F.col("s_suppkey") != F.col("lo.s_suppkey"))).groupBy("r_name").agg(F.min("x").alias("lo2"))
    outer = met.where((F.col("s_suppkey") != F.col("hi.s_suppkey"))).groupBy("r_name").agg(F.max("x").alias("hi2"))
    got = met.join(inner, "r_name", "left").join(outer, "r_name", "left")
    lo = F.when(F.col("s_suppkey") == F.col("lo.s_suppkey"), F.col("lo2")).otherwise(F.col("lo.x"))
    hi = F.when(F.col("s_suppkey") == F.col("hi.s_suppkey"), F.col("hi2")).otherwise(F.col("hi.x"))
    flag = F.when(F.col("n") < 6, F.lit(None)).when((F.col("x") < lo) | (F.col("x") > hi), "outside").otherwise("inside")
    return got.select("s_suppkey", "r_name", (F.col("n") - 1).alias("others"), flag.cast("string").alias("flag"))


@query("tier_rollup", "SELECT coalesce(l_returnflag, 'all') AS tier, cast(count(*) AS bigint) AS reads, sum(l_quantity) AS mass, cast(count(*) FILTER (l_linenumber = 1) AS bigint) AS agree FROM lineitem GROUP BY ROLLUP (l_returnflag)", prelude=False)
def tier_rollup(v: Views):
    return v.table("lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("reads"), F.sum("l_quantity").alias("mass"), F.sum((F.col("l_linenumber") == 1).cast("long")).alias("agree")).select(F.coalesce("l_returnflag", F.lit("all")).alias("tier"), "reads", "mass", "agree")


@query("taxonomy_grouping_sets", """
SELECT o_orderstatus AS status, CASE WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'segment' END AS dimension, coalesce(o_orderpriority, c_mktsegment) AS value, cast(count(*) AS bigint) AS reads
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus, c_mktsegment))
""", prelude=False)
def taxonomy_grouping_sets(v: Views):
    o, c = v.table("orders"), v.table("customer")
    d = o.join(c, o.o_custkey == c.c_custkey)
    got = d.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus", "c_mktsegment"]], "o_orderstatus", "o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("reads"), F.grouping("o_orderpriority").alias("g"))
    return got.select(F.col("o_orderstatus").alias("status"), F.when(F.col("g") == 0, "priority").otherwise("segment").alias("dimension"), F.coalesce("o_orderpriority", "c_mktsegment").alias("value"), "reads")


@query("probe_cube", """
SELECT grouping(a) + 2 * grouping(b) AS level, a, b, sum(q) AS mass, cast(count(DISTINCT p) AS bigint) AS probes FROM (SELECT l_quantity >= 25 AS a, l_discount >= 0.05 AS b, l_quantity AS q, l_partkey AS p FROM lineitem) GROUP BY CUBE (a, b)
""", prelude=False)
def probe_cube(v: Views):
    """Mass and distinct probes at every level of two flags.

    A probe's rows meet in one task and become one row of its cells, one per pair of flags, before the levels are formed;
    so no row is multiplied before it is summed, and probes are counted as rows."""
    d = v.table("lineitem").select((F.col("l_quantity") >= 25).alias("a"), (F.col("l_discount") >= 0.05).alias("b"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))
    flags = [True, False, None]
    own = [F.col("a").eqNullSafe(F.lit(x)) & F.col("b").eqNullSafe(F.lit(y)) for x in flags for y in flags]
    cells = dealt(d, "p").groupBy("p").agg(*(F.sum(F.when(c, F.col("q"))).alias(f"q{k}") for k, c in enumerate(own)), *(F.count(F.when(c, 1)).alias(f"n{k}") for k, c in enumerate(own)))

    def level(g: int, x: bool | None, y: bool | None) -> Column:
        some = [3 * i + j for i in range(3) for j in range(3) if (g & 1 or flags[i] is x) and (g & 2 or flags[j] is y)]
        mass = reduce(lambda m, k: F.when(m.isNull(), F.col(f"q{k}")).otherwise(m + F.coalesce(F.col(f"q{k}"), F.lit(0.0))), some, F.lit(None).cast("double"))
        rows = sum((F.col(f"n{k}") for k in some), F.lit(0))
        return F.struct(F.lit(g).cast("long").alias("level"), F.lit(x).cast("boolean").alias("a"), F.lit(y).cast("boolean").alias("b"), mass.alias("mass"), rows.alias("rows"))

    levels = [level(0, x, y) for x in flags for y in flags] + [level(1, None, y) for y in flags] + [level(2, x, None) for x in flags] + [level(3, None, None)]
    each = cells.select("p", F.inline(F.filter(F.array(*levels), lambda s: s["rows"] > 0)))
    return each.groupBy("level", "a", "b").agg(F.sum("mass").alias("mass"), F.count("p").alias("probes")).select("a", "b", "level", "mass", "probes")


@query("pivot_top_genes", """
, t AS (SELECT feature_id, sum(v) FILTER (m = 'A') AS a, sum(v) FILTER (m = 'N') AS n, sum(v) FILTER (m = 'R') AS r FROM obs GROUP BY feature_id)
SELECT feature_id, a AS "A", n AS "N", r AS "R" FROM t ORDER BY a DESC, feature_id LIMIT 8
""")
def pivot_top_genes(v: Views):
    return v.obs().groupBy("feature_id").pivot("m", ["A", "N", "R"]).agg(F.sum("v")).orderBy(F.desc("A"), "feature_id").limit(8)


@query("unpivot_contrasts", """
, t AS (SELECT feature_id, sum(v) FILTER (m = 'A') AS a, sum(v) FILTER (m = 'N') AS n, sum(v) FILTER (m = 'R') AS r FROM obs GROUP BY feature_id)
SELECT feature_id, metric, value FROM (SELECT feature_id, a - r AS a_minus_r, n - r AS n_minus_r FROM t) UNPIVOT (value FOR metric IN (a_minus_r, n_minus_r))
""")
def unpivot_contrasts(v: Views):
    t = v.obs().groupBy("feature_id").pivot("m", ["A", "N", "R"]).agg(F.sum("v"))
    d = t.select("feature_id", (F.col("A") - F.col("R")).alias("a_minus_r"), (F.col("N") - F.col("R")).alias("n_minus_r"))
    return d.unpivot("feature_id", ["a_minus_r", "n_minus_r"], "metric", "value").where("value is not null")


@query("table_diff", """
, x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders), y AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN y.k IS NULL THEN 'removed' WHEN x.k IS NULL THEN 'added' WHEN x.s IS DISTINCT FROM y.s THEN 'changed' ELSE 'same' END AS kind, cast(count(*) AS bigint) AS n FROM x FULL OUTER JOIN y ON x.k = y.k GROUP BY ALL
""")
def table_diff(v: Views):
    o = v.table("orders")
    x = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.lit(True).alias("inx"))
    y = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("t"), F.lit(True).alias("iny"))
    kind = F.when(F.col("iny").isNull(), "removed").when(F.col("inx").isNull(), "added").when(F.col("s").eqNullSafe(F.col("t")), "same").otherwise("changed")
    return x.join(y, "k", "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("reciprocal_best", """
, k AS (SELECT l_suppkey AS a, l_partkey % 97 AS b, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb FROM k)
SELECT a, b, cast(n AS bigint) AS n FROM r WHERE ra = 1 AND rb = 1
""")
def reciprocal_best(v: Views):
    k = v.table("lineitem").groupBy(F.col("l_suppkey").alias("a"), F.pmod("l_partkey", F.lit(97)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = lambda own, other: k.groupBy(own).agg(F.min(F.struct((-F.col("n")).alias("m"), other)).alias("t")).select(own, F.col("t")[other].alias(other))
    return k.join(best("a", "b"), ["a", "b"]).join(best("b", "a"), ["a", "b"]).select("a", "b", "n")


@query("macro_closure", """
WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey // 2 AS b FROM orders WHERE o_orderkey > 1), k AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT root, b, depth + 1 FROM k JOIN e ON e.a = k.node)
SELECT root, cast(count(*) AS bigint) AS reached, max(depth)::int AS depth FROM k GROUP BY root
""", prelude=False)
def macro_closure(v: Views):
    """How many macros each one includes, over include edges that name one macro at most: pointers double every round."""
    o = v.table("orders").select(F.col("o_orderkey").alias("root"))
    at = cut(o.select("root", F.when(F.col("root") > 1, F.floor(F.col("root") / 2)).alias("node"), F.lit(0).alias("depth")))
    at = at.withColumn("depth", F.when(F.col("node").isNotNull(), 1).otherwise(0))
    while not at.where("node is not null").isEmpty():
        step = at.select(F.col("root").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        met = at.join(step, "node", "left")
        at = cut(met.select("root", F.col("next").alias("node"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return at.select("root", (F.col("depth") + 1).cast("long").alias("reached"), F.col("depth").cast("int").alias("depth"))


@query("json_path", "SELECT event_type, cast(count(*) AS bigint) AS n, sum(cast(json_extract(props, '$.k') AS bigint))::bigint AS total FROM events GROUP BY event_type", prelude=False)
def json_path(v: Views):
    return v.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("conversation_turns", "SELECT conv_id, turn, role, lead(role) OVER w AS next_role, cast(row_number() OVER w AS bigint) AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)", prelude=False)
def conversation_turns(v: Views):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return v.table("conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.row_number().over(w).cast("long").alias("place"))


@query("policy_mass_conserved", """
, s AS (SELECT m, unnest([1, 4, 8]) AS factor, r, c, v FROM obs), t AS (SELECT m, factor, sum(v) AS mass, count(DISTINCT (r // factor, c // factor)) AS units FROM s GROUP BY ALL)
SELECT m, max(mass) - min(mass) AS gap, cast(min(units) AS bigint) AS fewest, cast(max(units) AS bigint) AS most FROM t GROUP BY m
""")
def policy_mass_conserved(v: Views):
    s = v.obs().withColumn("factor", F.explode(F.array(F.lit(1), F.lit(4), F.lit(8))))
    per = s.groupBy("m", "factor", F.floor(F.col("r") / F.col("factor")).alias("pr"), F.floor(F.col("c") / F.col("factor")).alias("pc")).agg(F.sum("v").alias("v"))
    t = per.groupBy("m", "factor").agg(F.sum("v").alias("mass"), F.count(F.lit(1)).alias("units"))
    return t.groupBy("m").agg((F.max("mass") - F.min("mass")).alias("gap"), F.min("units").alias("fewest"), F.max("units").alias("most"))


@query("timing_summary", "SELECT o_orderpriority AS slide, round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, round(quantile_cont(o_totalprice, 0.5) / (SELECT quantile_cont(o_totalprice, 0.5) FROM orders), 6) AS fold FROM orders GROUP BY o_orderpriority", prelude=False)
def timing_summary(v: Views):
    o = v.table("orders")
    s = o.select(F.col("o_orderpriority").alias("slide"), "o_totalprice")
    all_ = quantiles(s, [], "o_totalprice", m=0.5)
    got = s.groupBy("slide").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")).join(quantiles(s, ["slide"], "o_totalprice", median=0.5), "slide")
    return got.crossJoin(F.broadcast(all_)).select("slide", F.round("median", 4).alias("median"), "least", "most", F.round(F.try_divide("median", "m"), 6).alias("fold"))


@query("weighted_reference", "SELECT r_name, round(sum(s_acctbal * s_suppkey) / sum(s_suppkey), 4) AS weighted, round(avg(CASE WHEN s_acctbal > 0 THEN s_acctbal END), 4) AS finite_mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", prelude=False)
def weighted_reference(v: Views):
    d = _slides(v)
    return d.groupBy("r_name").agg(F.round(F.try_divide(F.sum(F.col("x") * F.col("s_suppkey")), F.sum("s_suppkey")), 4).alias("weighted"), F.round(F.avg(F.when(F.col("x") > 0, F.col("x"))), 4).alias("finite_mean"))


@query("missing_keys", "SELECT c_nationkey, cast(count(*) AS bigint) AS customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey", prelude=False)
def missing_keys(v: Views):
    c, o = v.table("customer"), v.table("orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))


@query("set_operations", "SELECT 'common' AS kind, cast(count(*) AS bigint) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'a_only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')", prelude=False)
def set_operations(v: Views):
    k = lambda m: v.table("lineitem").where(F.col("l_returnflag") == m).select("l_partkey")
    n = lambda d, kind: d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(k("A").intersect(k("R")), "common").unionByName(n(k("A").subtract(k("R")), "a_only"))


@query("column_profile", "SELECT o_orderstatus AS status, cast(count(*) AS bigint) AS n, cast(count(DISTINCT o_custkey) AS bigint) AS customers, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1", prelude=False)
def column_profile(v: Views):
    o = v.table("orders").withColumn("status", F.col("o_orderstatus"))
    got = o.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return got.join(quantiles(o, ["status"], "o_totalprice", p10=0.1, p90=0.9), "status").select("status", "n", "customers", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))



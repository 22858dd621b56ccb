"""Queries that summarise result tables: gates, accounts, axes, seals, timings and displayed numbers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..operators import report
from ..operators.exact import quantiles
from .registry import query
from .views import Views


@query("feature_subset", """
, f AS (SELECT p_partkey, p_brand, p_size > 48 AS targeted, p_type LIKE 'STANDARD%' AS expressed FROM part), h AS (SELECT p_brand, bool_or(targeted) AS anyt FROM f GROUP BY 1)
SELECT p_brand AS panel, cast(count(*) AS bigint) AS features, min(p_partkey)::bigint AS first FROM f JOIN h USING (p_brand) WHERE CASE WHEN anyt THEN targeted ELSE expressed END GROUP BY 1
""")
def feature_subset(v: Views):
    """Of every panel the targeted features if it has any, else those of the expression type."""
    f = v.table("part").select("p_partkey", "p_brand", (F.col("p_size") > 48).alias("targeted"), F.col("p_type").startswith("STANDARD").alias("expressed"))
    met = f.join(f.groupBy("p_brand").agg(F.bool_or("targeted").alias("some")), "p_brand")
    return met.where(F.when(F.col("some"), F.col("targeted")).otherwise(F.col("expressed"))).groupBy(F.col("p_brand").alias("panel")).agg(F.count(F.lit(1)).alias("features"), F.min("p_partkey").alias("first"))


@query("axis_mapping", """
WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part WHERE p_size > 25)
SELECT l_orderkey % 10 AS bucket, cast(count(*) FILTER (place IS NULL) AS bigint) AS missing, sum(coalesce(place, -1))::bigint AS digest FROM lineitem LEFT JOIN t ON p_partkey = l_partkey GROUP BY 1
""", prelude=False)
def axis_mapping(v: Views):
    """Places of keys on an ordered axis, -1 where it has none. Numbers come from counts of ranges, so no task holds the axis."""
    axis = v.table("part").where("p_size > 25").select("p_partkey", F.floor(F.col("p_partkey") / 1000).alias("range"))
    sizes = axis.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per thousand keys
    placed = axis.join(before, "range").select("p_partkey", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("p_partkey")) - 1).alias("place"))
    met = v.table("lineitem").join(placed, F.col("l_partkey") == F.col("p_partkey"), "left")
    return met.groupBy((F.col("l_orderkey") % 10).alias("bucket")).agg(F.count(F.when(F.col("place").isNull(), 1)).alias("missing"), F.sum(F.coalesce("place", F.lit(-1))).alias("digest"))


@query("gate_table", """
WITH m AS (SELECT o_orderpriority AS gate_of, count(*)::double AS orders, avg(o_totalprice) AS price, count(*) FILTER (o_orderstatus = 'F') / count(*) AS finished FROM orders GROUP BY 1),
l AS (SELECT gate_of, unnest([{'metric': 'finished', 'value': finished, 'least': 0.48}, {'metric': 'orders', 'value': orders, 'least': 100.0}, {'metric': 'price', 'value': price, 'least': 130000.0}]) AS x FROM m)
SELECT gate_of, bool_and(x.value >= x.least) AS passed, coalesce(string_agg(x.metric, ';' ORDER BY x.metric) FILTER (x.value < x.least), '') AS failed FROM l GROUP BY 1
""", prelude=False)
def gate_table(v: Views):
    """Metrics against their least values: whether a row passes, and what it fails at."""
    m = v.table("orders").groupBy(F.col("o_orderpriority").alias("gate_of")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished"))
    least = F.create_map(*(F.lit(x) for x in ("finished", 0.48, "orders", 100.0, "price", 130000.0)))
    long = m.unpivot("gate_of", ["finished", "orders", "price"], "metric", "value").withColumn("low", F.col("value") < F.element_at(least, F.col("metric")))
    return long.groupBy("gate_of").agg((~F.bool_or("low")).alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("low"), F.col("metric")))), ";").alias("failed"))


@query("account_partition", """
WITH k AS (SELECT l_returnflag AS run, CASE WHEN l_discount = 0 THEN 'no_candidate' WHEN l_tax = 0 THEN 'no_feature' WHEN l_linenumber = 1 THEN 'direct' ELSE 'resolved' END AS status, l_quantity AS q FROM lineitem),
p AS (SELECT run, status, count(*) AS reads, sum(q) AS mass FROM k GROUP BY ALL)
SELECT run, status, cast(reads AS bigint) AS reads, mass, round(reads / sum(reads) OVER (PARTITION BY run), 6) AS share, (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = p.run) = sum(reads) OVER (PARTITION BY run) AS reconciled FROM p
""", prelude=False)
def account_partition(v: Views):
    """Every read in one status: reads and mass of each, shares of the run, and whether they add up to it."""
    d = v.table("lineitem")
    status = F.when(F.col("l_discount") == 0, "no_candidate").when(F.col("l_tax") == 0, "no_feature").when(F.col("l_linenumber") == 1, "direct").otherwise("resolved")
    p = d.groupBy(F.col("l_returnflag").alias("run"), status.alias("status")).agg(F.count(F.lit(1)).alias("reads"), F.sum("l_quantity").alias("mass"))
    own = F.sum("reads").over(Window.partitionBy("run"))  # four statuses
    total = d.groupBy(F.col("l_returnflag").alias("run")).agg(F.count(F.lit(1)).alias("all"))
    return p.withColumn("sum", own).join(total, "run").select("run", "status", "reads", "mass", F.round(F.col("reads") / F.col("sum"), 6).alias("share"), (F.col("all") == F.col("sum")).alias("reconciled"))


@query("campaign_wins", """
WITH a AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY ALL), w AS (SELECT x.c_mktsegment AS method, count(*) FILTER (x.m > y.m) AS wins, count(*) FILTER (x.m < y.m) AS losses, count(*) FILTER (x.m = y.m) AS ties, round(median(x.m), 4) AS middle FROM a x JOIN a y ON x.c_nationkey = y.c_nationkey AND y.c_mktsegment = 'BUILDING' AND x.c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT method, wins::bigint AS wins, losses::bigint AS losses, ties::bigint AS ties, middle, (SELECT round(least(1.0, 2 * sum(c)), 9) FROM (SELECT exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2)) AS c FROM (SELECT unnest(range(0, least(wins, losses) + 1)) AS k))) AS p FROM w
""", prelude=False)
def campaign_wins(v: Views):
    """Methods against one of them over all datasets: wins, losses, ties, the exact chance, and the median."""
    a = quantiles(v.table("customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", m=0.5)
    base = a.where("c_mktsegment = 'BUILDING'").select("c_nationkey", F.col("m").alias("b"))
    n = lambda c: F.count(F.when(c, 1))
    w = a.where("c_mktsegment <> 'BUILDING'").join(base, "c_nationkey").groupBy(F.col("c_mktsegment").alias("method")).agg(n(F.col("m") > F.col("b")).alias("wins"), n(F.col("m") < F.col("b")).alias("losses"), n(F.col("m") == F.col("b")).alias("ties"), F.round(F.percentile("m", F.lit(0.5)), 4).alias("middle"))
    return w.withColumn("p", F.round(Q.binomial_two_sided(F.col("wins"), F.col("wins") + F.col("losses")), 9))


@query("role_differences", """
WITH p AS (SELECT c_mktsegment AS dataset, c_nationkey % 3 AS role, avg(c_acctbal) AS share FROM customer GROUP BY ALL), w AS (SELECT dataset, max(share) FILTER (role = 0) AS shared, max(share) FILTER (role = 1) AS gained, max(share) FILTER (role = 2) AS lost FROM p GROUP BY 1)
SELECT dataset, round(gained - shared, 4) AS gained_less_shared, round(lost - shared, 4) AS lost_less_shared, sign(gained - shared) = sign(sum(gained - shared) OVER ()) AS agrees FROM w
""", prelude=False)
def role_differences(v: Views):
    """Field rows by role side by side, their differences, and whether a dataset's sign is that of all."""
    role = F.element_at(F.array(F.lit("shared"), F.lit("gained"), F.lit("lost")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    w = v.table("customer").select(F.col("c_mktsegment").alias("dataset"), role.alias("role"), "c_acctbal").groupBy("dataset").pivot("role", ["shared", "gained", "lost"]).agg(F.avg("c_acctbal"))
    all_ = w.agg(F.sum(F.col("gained") - F.col("shared")).alias("all"))
    d = F.col("gained") - F.col("shared")
    return w.crossJoin(F.broadcast(all_)).select("dataset", F.round(d, 4).alias("gained_less_shared"), F.round(F.col("lost") - F.col("shared"), 4).alias("lost_less_shared"), (F.signum(d) == F.signum("all")).alias("agrees"))


@query("policy_grid", """
WITH g AS (SELECT l_returnflag AS policy, l_linestatus AS scale, sum(l_quantity) AS mass FROM lineitem GROUP BY ALL), k AS (SELECT p.policy, s.scale FROM (SELECT DISTINCT policy FROM g) p, (SELECT DISTINCT scale FROM g) s)
SELECT policy, cast(count(*) FILTER (mass IS NULL) AS bigint) AS missing, max(mass) - min(mass) AS gap FROM k LEFT JOIN g USING (policy, scale) GROUP BY 1
""", prelude=False)
def policy_grid(v: Views):
    """Whether every policy has every scale, and how far its masses lie apart."""
    g = v.table("lineitem").groupBy(F.col("l_returnflag").alias("policy"), F.col("l_linestatus").alias("scale")).agg(F.sum("l_quantity").alias("mass"))
    grid = g.select("policy").distinct().crossJoin(g.select("scale").distinct())  # policies by scales, as many as a report has
    return grid.join(g, ["policy", "scale"], "left").groupBy("policy").agg(F.count(F.when(F.col("mass").isNull(), 1)).alias("missing"), (F.max("mass") - F.min("mass")).alias("gap"))


@query("seal_check", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS own, CASE WHEN doc_id % 13 = 0 THEN sha256('other') ELSE sha256(coalesce(text, '')) END AS declared FROM documents)
SELECT doc_id % 10 AS part, cast(count(*) AS bigint) AS files, cast(count(*) FILTER (own = declared) AS bigint) AS sound, cast(count(*) FILTER (own <> declared) AS bigint) AS broken FROM d GROUP BY 1
""", prelude=False)
def seal_check(v: Views):
    """Hashes that seal documents declare, from their JSON, against those of the files they name."""
    d = v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    declared = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    seals = d.select(F.to_json(F.struct(F.lit("1").alias("schema"), F.lit("sealed").alias("status"), F.create_map(F.col("doc_id").cast("string"), declared).alias("files"))).alias("seal"))
    read = seals.select(F.from_json("seal", "schema string, status string, files map<string,string>").alias("s")).where("s.schema = '1' and s.status = 'sealed' and size(s.files) > 0")
    named = read.select(F.explode("s.files").alias("name", "hash")).select(F.col("name").cast("long").alias("doc_id"), "hash")
    met = named.join(d.select("doc_id", F.sha2("text", 256).alias("own")), "doc_id")
    n = lambda c: F.count(F.when(c, 1))
    return met.groupBy((F.col("doc_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("files"), n(F.col("own") == F.col("hash")).alias("sound"), n(F.col("own") != F.col("hash")).alias("broken"))


@query("stage_accounting", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 19 <> 0)
SELECT a.v AS stage, cast(count(*) FILTER (b.k IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS bigint) AS equal, cast(count(*) FILTER (b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS bigint) AS unequal, cast(count(*) FILTER (b.k IS NULL) AS bigint) AS absent FROM a LEFT JOIN b USING (k) GROUP BY 1
""", prelude=False)
def stage_accounting(v: Views):
    """Invariant fields of two runs, key by key; a missing value equals only a missing value."""
    o, k = v.table("orders"), F.col("o_orderkey")
    a = o.select(k.alias("k"), F.col("o_orderstatus").alias("stage"))
    b = o.where(k % 19 != 0).select(k.alias("k"), F.when(k % 17 != 0, F.col("o_orderstatus")).alias("other"), F.lit(True).alias("there"))
    n = lambda c: F.count(F.when(c, 1))
    same, there = F.col("stage").eqNullSafe(F.col("other")), F.col("there").isNotNull()
    return a.join(b, "k", "left").groupBy("stage").agg(n(there & same).alias("equal"), n(there & ~same).alias("unequal"), n(~there).alias("absent"))


@query("timing_table", """
WITH t AS (SELECT o_orderpriority AS slide, o_orderstatus AS pipeline, (o_orderkey % 4000) + 60 AS s FROM orders WHERE o_orderstatus <> 'P'), g AS (SELECT slide, pipeline, median(s) AS m, min(s) AS lo, max(s) AS hi FROM t GROUP BY ALL)
SELECT slide, max(m) FILTER (pipeline = 'F') AS open_median, cast(min(lo) FILTER (pipeline = 'F') AS bigint) AS open_least, round(max(m) FILTER (pipeline = 'O') / max(m) FILTER (pipeline = 'F'), 6) AS fold, round(100 * (1 - max(m) FILTER (pipeline = 'F') / max(m) FILTER (pipeline = 'O')), 6) AS reduction FROM g GROUP BY 1
""", prelude=False)
def timing_table(v: Views):
    """Medians of two pipelines' run times by slide, read from h:mm:ss, with fold and reduction."""
    shown = report.display((F.col("o_orderkey") % 4000 + 60).cast("double"), "duration")
    t = v.table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("slide"), F.col("o_orderstatus").alias("pipeline"), report.elapsed_seconds(shown).alias("s"))
    half = quantiles(t, ["slide", "pipeline"], "s", m=0.5).groupBy("slide").pivot("pipeline", ["F", "O"]).agg(F.max("m"))
    g = t.groupBy("slide").agg(F.min(F.when(F.col("pipeline") == "F", F.col("s"))).cast("long").alias("open_least")).join(half.select("slide", F.col("F").alias("open_median"), F.col("O").alias("other")), "slide")
    return g.select("slide", "open_median", "open_least", F.round(F.try_divide("other", "open_median"), 6).alias("fold"), F.round(100 * (1 - F.try_divide("open_median", "other")), 6).alias("reduction"))


@query("displayed_numbers", "SELECT c_mktsegment AS segment, cast(count(*) AS bigint) AS shown, cast(count(*) FILTER (s <> round(s / 100) * 100) AS bigint) AS odd, sum(s)::bigint AS total FROM (SELECT c_mktsegment, (c_custkey * 37) % 90000 AS s FROM customer) GROUP BY 1", prelude=False)
def displayed_numbers(v: Views):
    """Numbers as a report shows them, read back from their text."""
    s = ((F.col("c_custkey") * 37) % 90000).cast("double")
    back = F.regexp_replace(report.display(s, "integer"), ",", "").cast("long")
    d = v.table("customer").select(F.col("c_mktsegment").alias("segment"), back.alias("s"))
    return d.groupBy("segment").agg(F.count("s").alias("shown"), F.count(F.when(F.col("s") % 100 != 0, 1)).alias("odd"), F.sum("s").alias("total"))


@query("expression_numbers", """
WITH m AS (SELECT l_returnflag AS flag, sum(l_quantity) AS q, sum(l_extendedprice) AS p, count(*)::double AS n FROM lineitem GROUP BY 1)
SELECT flag, round(p / q, 6) AS unit_price, round(least(q, n) + greatest(q, n) * 2, 4) AS mixed, q - n AS difference FROM m
""", prelude=False)
def expression_numbers(v: Views):
    """Numbers that trees of sums, ratios and extremes name over a table's results."""
    m = v.table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.create_map(F.lit("q"), F.sum("l_quantity"), F.lit("p"), F.sum("l_extendedprice"), F.lit("n"), F.count(F.lit(1)).cast("double")).alias("value"))
    e = report.compile_expression
    mixed = e({"sum": [{"min": ["q", "n"]}, {"product": [{"max": ["q", "n"]}, 2]}]})
    return m.select("flag", F.round(e({"ratio": ["p", "q"]}), 6).alias("unit_price"), F.round(mixed, 4).alias("mixed"), e({"difference": ["q", "n"]}).alias("difference"))


@query("candidate_lineage", """
WITH c AS (SELECT event_id, event_id % 5 > 0 AS hit, CASE WHEN event_id % 5 = 0 AND event_id % 3 > 0 THEN 'g' || (user_id % 9) END AS aligned FROM events)
SELECT CASE WHEN hit THEN 'hash' WHEN aligned IS NULL THEN 'dropped' ELSE 'alignment' END AS route, aligned AS feature, cast(count(*) AS bigint) AS reads, round(ln(count(*) + 1), 6) AS log_prior FROM c GROUP BY ALL
""", prelude=False)
def candidate_lineage(v: Views):
    """Reads that hashes miss, with the features that alignment finds, those without one dropped, and the prior rebuilt."""
    e = v.table("events").select("event_id", "user_id")
    hits = e.where("event_id % 5 > 0").select("event_id", F.lit(True).alias("hit"))
    found = e.join(hits, "event_id", "left_anti").where("event_id % 3 > 0").select("event_id", F.concat(F.lit("g"), (F.col("user_id") % 9).cast("string")).alias("feature"))
    met = e.join(hits, "event_id", "left").join(found, "event_id", "left")
    route = F.when(F.col("hit"), "hash").when(F.col("feature").isNull(), "dropped").otherwise("alignment")
    return met.groupBy(route.alias("route"), "feature").agg(F.count(F.lit(1)).alias("reads"), F.round(F.ln(F.count(F.lit(1)) + 1), 6).alias("log_prior"))

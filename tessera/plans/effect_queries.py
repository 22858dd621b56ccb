"""Queries on gene effects, eligible genes, reliability and the comparison of methods."""

from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..functions import stats as S
from ..operators import effects as E
from ..operators import grid, sparse
from .registry import query
from .views import Views

_P = ", pa AS (SELECT feature_id, r // 8 * 1000 + c // 8 AS patch, sum(v) AS v FROM ma GROUP BY ALL), pb AS (SELECT feature_id, r // 8 * 1000 + c // 8 AS patch, sum(v) AS v FROM mb GROUP BY ALL)"


def _patch(v: Views, m: str):
    return v.matrix(m).groupBy("feature_id", (grid.parent(F.col("r"), 8) * 1000 + grid.parent(F.col("c"), 8)).alias("patch")).agg(F.sum("v").alias("v"))


def _effect_sql(name: str, source: str) -> str:
    return f""", {name}_t AS (SELECT feature_id, v AS x, count(*) FILTER (patch % 3 = 0) AS p, count(*) FILTER (patch % 3 > 0) AS q FROM {source} GROUP BY ALL),
{name}_k AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY feature_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS area FROM {name}_t),
{name} AS (SELECT feature_id, sum(p) AS n_rich, sum(q) AS n_poor, sum(p * x) / sum(p) - sum(q * x) / sum(q) AS effect, sum(area) / (sum(p) * sum(q)) AS auc FROM {name}_k GROUP BY feature_id)"""


def _effects(v: Views, m: str):
    return E.group_effects(_patch(v, m).select("feature_id", F.col("v").alias("x"), (F.col("patch") % 3 == 0).alias("rich")), ["feature_id"])


@query("gene_effects", _P + _effect_sql("ea", "pa") + " SELECT feature_id, n_rich::bigint AS n_rich, n_poor::bigint AS n_poor, round(effect, 6) AS effect, round(auc, 6) AS auc, round(CASE WHEN effect < 0 THEN 1 - auc ELSE auc END, 6) AS oriented_auc FROM ea")
def gene_effects(v: Views):
    return _effects(v, "A").select("feature_id", "n_rich", "n_poor", *(F.round(c, 6).alias(c) for c in ("effect", "auc", "oriented_auc")))


@query("method_wins", _P + _effect_sql("ea", "pa") + _effect_sql("eb", "pb") + """
, w AS (SELECT count(*) FILTER (round(a.auc, 9) > round(b.auc, 9)) AS wins, count(*) FILTER (round(a.auc, 9) < round(b.auc, 9)) AS losses, count(*) FILTER (round(a.auc, 9) = round(b.auc, 9)) AS ties FROM ea a JOIN eb b USING (feature_id))
SELECT wins::bigint AS wins, losses::bigint AS losses, ties::bigint AS ties, (SELECT round(least(1.0, 2 * sum(c)), 9) FROM (SELECT exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2)) AS c FROM range(0, least(wins, losses) + 1) t(k))) AS p FROM w
""")
def method_wins(v: Views):
    """Features on which one method tells the groups apart better, and the exact chance of so uneven a split."""
    rounded = lambda m: _effects(v, m).withColumn("auc", F.round("auc", 9))
    w = E.wins(rounded("A"), rounded("R"), ["feature_id"], "auc")
    return w.withColumn("p", F.round(Q.binomial_two_sided(F.col("wins").cast("int"), (F.col("wins") + F.col("losses")).cast("int")), 9))


@query("labelled_cells", ", k AS (SELECT r * 100000 + c AS cell, (r // 16) * 1000 + c // 16 AS cluster, sum(v) FILTER (feature_id IN (3, 7)) AS label FROM ma GROUP BY ALL) SELECT cluster, cast(count(*) AS bigint) AS cells FROM k WHERE cluster IN (1, 1001, 1002, 2002) AND label > 0 GROUP BY cluster")
def labelled_cells(v: Views):
    m = v.matrix("A").withColumn("cell", F.col("r") * 100000 + F.col("c"))
    clusters = m.select("cell", (grid.parent(F.col("r"), 16) * 1000 + grid.parent(F.col("c"), 16)).alias("cluster")).distinct()
    return E.labelled_cells(clusters, m, [1, 1001, 1002, 2002], [3, 7]).groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))


@query("eligible_genes", _P + ", x AS (SELECT feature_id FROM pa GROUP BY 1 HAVING sum(v) >= 4000 AND min(v) < max(v)), y AS (SELECT feature_id FROM pb GROUP BY 1 HAVING sum(v) >= 4000 AND min(v) < max(v)) SELECT feature_id FROM x WHERE feature_id IN (SELECT feature_id FROM y)")
def eligible_genes(v: Views):
    return E.eligible_genes([_patch(v, "A"), _patch(v, "R")], 4000)


@query("split_half_reliability")
def split_half_reliability(v: Views):
    """Coins are bits of hashes that only Spark has, so no SQL gives the same halves."""
    return E.split_half_reliability(_patch(v, "A"), 11).withColumn("reliability", F.round("reliability", 9))


@query("reliability_mass_curve", _P + """
, g AS (SELECT feature_id, coalesce(corr(pa.v, pb.v), 0) AS k, sum(pa.v + pb.v) AS weight FROM pa JOIN pb USING (feature_id, patch) GROUP BY feature_id),
o AS (SELECT row_number() OVER w AS place, sum(weight) OVER w AS upto, sum(weight) OVER () AS total FROM g WINDOW w AS (ORDER BY round(k, 9) DESC, feature_id)), q AS (SELECT t::double AS target, place, upto / total AS share FROM o, (SELECT unnest([0.25, 0.5, 0.9]) AS t) WHERE upto >= t * total)
SELECT target, cast(min(place) AS bigint) AS place, round(min(share), 6) AS share FROM q GROUP BY target
""")
def reliability_mass_curve(v: Views):
    met = _patch(v, "A").withColumnRenamed("v", "a").join(_patch(v, "R").withColumnRenamed("v", "b"), ["feature_id", "patch"])
    g = met.groupBy("feature_id").agg(*S.moments(F.col("a"), F.col("b")), F.sum(F.col("a") + F.col("b")).alias("weight"))
    g = g.select("feature_id", F.round(F.coalesce(S.pearson_null(), F.lit(0.0)), 9).alias("reliability"), "weight")
    return E.mass_curve(g, (0.25, 0.5, 0.9)).withColumn("share", F.round("share", 6))


@query("matrix_delta", """
, d AS (SELECT feature_id, greatest(a - b, 0) AS more, least(a, b) AS shared, a FROM al)
SELECT feature_id, sum(more) AS more, sum(shared) AS shared, round(sum(more) / sum(a), 6) AS share FROM d GROUP BY feature_id HAVING sum(a) > 0
""")
def matrix_delta(v: Views):
    """What one method has beyond the other, and what both have, by feature."""
    a, b = F.col("a"), F.col("b")
    d = sparse.align(v.matrix("A"), v.matrix("R")).groupBy("feature_id").agg(F.sum(F.greatest(a - b, F.lit(0.0))).alias("more"), F.sum(F.least(a, b)).alias("shared"), F.sum("a").alias("a"))
    return d.where("a > 0").select("feature_id", "more", "shared", F.round(F.col("more") / F.col("a"), 6).alias("share"))


@query("method_metrics", _P + """
, x AS (SELECT patch, coalesce(pa.v, 0) AS a, coalesce(pb.v, 0) AS b FROM pa FULL JOIN pb USING (feature_id, patch))
SELECT patch, cast(count(*) AS bigint) AS genes, round(corr(a, b), 6) AS pearson, round(sum(abs(a - b)) / sum(a + b), 6) AS distance, round(sum(least(a, b)) / sum(b), 6) AS covered FROM x GROUP BY patch
""")
def method_metrics(v: Views):
    """Per patch how one method's genes agree with another's."""
    x = _patch(v, "A").withColumnRenamed("v", "a").join(_patch(v, "R").withColumnRenamed("v", "b"), ["feature_id", "patch"], "full_outer").fillna(0.0, ["a", "b"])
    a, b = F.col("a"), F.col("b")
    g = x.groupBy("patch").agg(*S.moments(a, b), F.sum(F.abs(a - b)).alias("apart_all"), F.sum(F.least(a, b)).alias("least"))
    return g.select("patch", F.col("n").alias("genes"), F.round(S.pearson_null(), 6).alias("pearson"), F.round(F.try_divide("apart_all", F.col("sx") + F.col("sy")), 6).alias("distance"), F.round(F.try_divide("least", "sy"), 6).alias("covered"))


@query("marker_coverage", """
, t AS (SELECT p_brand AS symbol, p_partkey % 50 AS feature_id FROM part GROUP BY ALL), f AS (SELECT DISTINCT feature_id FROM ma)
SELECT symbol, cast(count(*) AS bigint) AS genes, cast(count(f.feature_id) AS bigint) AS found FROM t LEFT JOIN f USING (feature_id) GROUP BY symbol
""")
def marker_coverage(v: Views):
    """Of the genes of every marker how many the matrix has."""
    t = v.table("part").select(F.col("p_brand").alias("symbol"), (F.col("p_partkey") % v.features).alias("feature_id")).distinct()
    f = v.matrix("A").select("feature_id", F.lit(1).alias("one")).distinct()
    return t.join(f, "feature_id", "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("genes"), F.count("one").alias("found"))


@query("text_alignments", "SELECT p_partkey, levenshtein(p_brand, 'Brand#' || (p_size % 60))::int AS cost, true AS whole FROM part", prelude=False)
def text_alignments(v: Views):
    """Alignments at the fewest edits; without their gaps both texts are whole."""
    other = F.concat(F.lit("Brand#"), (F.col("p_size") % 60).cast("string"))
    d = v.table("part").select("p_partkey", "p_brand", other.alias("other"), E.aligned(F.col("p_brand"), other).alias("a"))
    whole = (F.translate("a.first", "-", "") == F.col("p_brand")) & (F.translate("a.second", "-", "") == F.col("other")) & (F.length("a.first") == F.length("a.second"))
    return d.select("p_partkey", "a.cost", whole.alias("whole"))


@query("cleaned_values", "SELECT l_returnflag AS flag, cast(count(*) FILTER (d = 0) AS bigint) AS zeros, round(sum(d), 4) AS total FROM (SELECT l_returnflag, CASE WHEN abs(l_discount - 0.05) <= 1e-5 THEN 0 ELSE l_discount - 0.05 END AS d FROM lineitem) GROUP BY 1", prelude=False)
def cleaned_values(v: Views):
    d = v.table("lineitem").select(F.col("l_returnflag").alias("flag"), Q.clean_roundoff(F.col("l_discount") - 0.05).alias("d"))
    return d.groupBy("flag").agg(F.count(F.when(F.col("d") == 0, 1)).alias("zeros"), F.round(F.sum("d"), 4).alias("total"))


@query("live_text", "SELECT event_type, cast(sum(length(event_type || ' 5\\% ')) AS bigint) AS letters FROM events GROUP BY 1", prelude=False)
def live_text(v: Views):
    """Text without its comments."""
    line = F.concat(F.col("event_type"), F.lit(" 5\\% "), F.lit("% user "), F.col("user_id").cast("string"))
    return v.table("events").groupBy("event_type").agg(F.sum(F.length(Q.uncommented(line)).cast("long")).alias("letters"))


@query("macro_numbers", """
WITH o AS (SELECT o_orderpriority AS name, round(sum(o_totalprice), 2) AS old, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 2) AS new FROM orders GROUP BY 1), a AS (SELECT name, CASE WHEN name LIKE '1%' THEN '2-HIGH' ELSE name END AS target FROM o)
SELECT a.name, a.target, t.old AS old, s.new AS new, CASE WHEN t.old = s.new THEN 'same' ELSE 'changed' END AS state FROM a JOIN o t ON t.name = a.target JOIN o s ON s.name = a.name
""", prelude=False)
def macro_numbers(v: Views):
    """Numbers of a text before and after, an alias standing for another name's."""
    o = v.table("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("old"), F.round(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 2).alias("new"))
    a = o.select("name", "new", F.when(F.col("name").startswith("1"), "2-HIGH").otherwise(F.col("name")).alias("target"))
    met = a.join(o.select(F.col("name").alias("target"), "old"), "target")
    return met.select("name", "target", "old", "new", F.when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("state"))

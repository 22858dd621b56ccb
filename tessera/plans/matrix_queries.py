"""Queries on matrices, masks and fields."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import grid, ranking, sparse
from ..operators.exact import exact_sums, quantiles
from .registry import query
from .views import Views


@query("mask_summary", """
SELECT inside, cast(count(*) AS bigint) AS cells, round(count(*) / (SELECT s * s * 1.0 FROM side), 6) AS area_fraction, sum(v) AS mass, round(sum(v) / (SELECT sum(v) FROM dense), 6) AS mass_fraction,
  round(sum(v) / (SELECT sum(v) FROM dense) / (count(*) / (SELECT s * s * 1.0 FROM side)), 6) AS enrichment, round(sum(v) / count(*), 6) AS density FROM dense GROUP BY inside
""")
def mask_summary(v: Views):
    d = v.dense()
    all_ = d.agg(F.count(F.lit(1)).alias("N"), F.sum("v").alias("M"))
    got = d.groupBy("inside").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("mass")).crossJoin(F.broadcast(all_))  # one row
    area, mass = F.col("cells") / F.col("N"), S.safe_fraction(F.col("mass"), F.col("M"))
    return got.select("inside", "cells", F.round(area, 6).alias("area_fraction"), "mass", F.round(mass, 6).alias("mass_fraction"), F.round(S.safe_fraction(mass, area), 6).alias("enrichment"), F.round(F.col("mass") / F.col("cells"), 6).alias("density"))


@query("matrix_compare", """
, t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM al)
SELECT cast(count(*) AS bigint) AS entries, cast(count(*) FILTER (a > 0) AS bigint) AS nnz_a, cast(count(*) FILTER (b > 0) AS bigint) AS nnz_b, sum(a) AS mass_a, sum(b) AS mass_b, round(sum(a) / sum(b), 6) AS mass_ratio,
  sum(abs(a - b)) AS l1, cast(count(*) FILTER (abs(a - b) <= 1e-12) AS bigint) AS exact, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(sum(abs(a / ta - b / tb)) / 2, 6) AS tv, round(corr(a, b), 6) AS pearson FROM al, t
""")
def matrix_compare(v: Views):
    return sparse.matrix_compare(v.matrix("A"), v.matrix("R"))


_AXIS = """
, x AS (SELECT '{axis}' AS axis, {axis} AS k, sum(a) AS a, sum(b) AS b FROM al GROUP BY {axis})
SELECT cast(count(*) AS bigint) AS n, round(corr(a, b), 6) AS pearson, round(corr(ln(1 + a), ln(1 + b)), 6) AS pearson_log1p, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM x
"""


@query("axis_totals_compare", _AXIS.format(axis="feature_id"))
def axis_totals_compare(v: Views):
    return sparse.axis_compare(v.matrix("A"), v.matrix("R"), ["feature_id"])


@query("bin_axis_compare", """
, x AS (SELECT r, c, sum(a) AS a, sum(b) AS b FROM al GROUP BY r, c)
SELECT cast(count(*) AS bigint) AS n, round(corr(a, b), 6) AS pearson, round(corr(ln(1 + a), ln(1 + b)), 6) AS pearson_log1p, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM x
""")
def bin_axis_compare(v: Views):
    return sparse.axis_compare(v.matrix("A"), v.matrix("R"), ["r", "c"])


@query("shared_excess", "SELECT r, c, sum(least(a, b)) AS shared, sum(greatest(a - b, 0)) AS a_only, sum(greatest(b - a, 0)) AS b_only FROM al GROUP BY r, c")
def shared_excess(v: Views):
    return sparse.shared_excess(v.matrix("A"), v.matrix("R"), ["r", "c"])


@query("nesting_audit", """
, d AS (SELECT coalesce(mp.v, 0) - coalesce(ma.v, 0) AS d FROM mp FULL OUTER JOIN ma ON ma.feature_id = mp.feature_id AND ma.r = mp.r AND ma.c = mp.c)
SELECT cast(count(*) AS bigint) AS cells, cast(count(*) FILTER (d > 0) AS bigint) AS higher, cast(count(*) FILTER (d < 0) AS bigint) AS lower, cast(count(*) FILTER (d = 0) AS bigint) AS equal,
  sum(greatest(d, 0)) AS gained, sum(least(d, 0)) AS lost, min(d) AS least, max(d) AS most, bool_and(d >= 0) AS superset FROM d
""")
def nesting_audit(v: Views):
    return sparse.nesting_audit(v.matrix("A"), v.matrix("A", "R"), sparse.KEY)


@query("increment_field", """
, d AS (SELECT mp.r, mp.c, mp.v - coalesce(ma.v, 0) AS d FROM mp LEFT JOIN ma ON ma.feature_id = mp.feature_id AND ma.r = mp.r AND ma.c = mp.c)
SELECT r, c, sum(d) AS v FROM d GROUP BY r, c HAVING sum(d) > 0
""")
def increment_field(v: Views):
    return sparse.increment_field(v.matrix("A", "R"), v.matrix("A"))


@query("conservation", """
SELECT round(sum(least(a, b)) + sum(greatest(a - b, 0)) - sum(a), 6) AS a_gap, round(sum(least(a, b)) + sum(greatest(b - a, 0)) - sum(b), 6) AS b_gap FROM al
""")
def conservation(v: Views):
    d = sparse.align(v.matrix("A"), v.matrix("R"))
    x, y, zero = F.col("a"), F.col("b"), F.lit(0.0)
    s = exact_sums(d, [], shared=F.least(x, y), more=F.greatest(x - y, zero), less=F.greatest(y - x, zero), a="a", b="b")
    return s.select(F.round(F.col("shared") + F.col("more") - F.col("a"), 6).alias("a_gap"), F.round(F.col("shared") + F.col("less") - F.col("b"), 6).alias("b_gap"))


@query("gene_bin_residuals", """
, w AS (SELECT r, c, CASE WHEN inside THEN 1.0 ELSE 0.0 END AS w FROM mask)
SELECT feature_id, sum(a) AS total_a, sum(b) AS total_b, sum(least(a, b)) AS shared, sum(greatest(a - b, 0)) AS a_residual, sum(greatest(b - a, 0)) AS b_residual,
  sum(greatest(a - b, 0) * w) AS a_inside, sum(greatest(b - a, 0) * w) AS b_inside, cast(count(*) FILTER (a > 0) AS bigint) AS nnz_a,
  round(CASE WHEN sum(greatest(a - b, 0)) > 0 THEN sum(greatest(a - b, 0) * w) / sum(greatest(a - b, 0)) ELSE 0 END, 6) AS a_fraction,
  round(CASE WHEN sum(greatest(b - a, 0)) > 0 THEN sum(greatest(b - a, 0) * w) / sum(greatest(b - a, 0)) ELSE 0 END, 6) AS b_fraction
FROM al JOIN w USING (r, c) GROUP BY feature_id
""")
def gene_bin_residuals(v: Views):
    return sparse.residuals_by_feature(v.matrix("A"), v.matrix("R"), v.mask().select("r", "c", F.col("inside").cast("double").alias("w")))


@query("effective_gene_count", "SELECT r, c, round(sum(v) * sum(v) / sum(v * v), 6) AS effective FROM ma GROUP BY r, c")
def effective_gene_count(v: Views):
    return sparse.effective_features(v.matrix("A"))


@query("compartment_fractions", """
SELECT r // 8 AS r, c // 8 AS c, cast(count(*) AS bigint) AS children, round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 6) AS inside_fraction, cast(count(*) FILTER (support) AS bigint) AS supported FROM mask GROUP BY r // 8, c // 8
""")
def compartment_fractions(v: Views):
    return v.mask().groupBy(grid.parent(F.col("r"), 8).alias("r"), grid.parent(F.col("c"), 8).alias("c")).agg(F.count(F.lit(1)).alias("children"), F.round(F.avg(F.col("inside").cast("double")), 6).alias("inside_fraction"), F.sum(F.col("support").cast("long")).alias("supported"))


@query("expand_uniform", """
, k AS (SELECT r, c, r // 8 AS pr, c // 8 AS pc FROM mask WHERE support), n AS (SELECT pr, pc, count(*) AS n FROM k GROUP BY pr, pc),
p AS (SELECT r // 8 AS pr, c // 8 AS pc, sum(v) AS v FROM field GROUP BY r // 8, c // 8)
SELECT k.r, k.c, round(p.v / n.n, 6) AS v FROM k JOIN n USING (pr, pc) JOIN p USING (pr, pc)
""")
def expand_uniform(v: Views):
    coarse = v.field().groupBy(grid.parent(F.col("r"), 8).alias("r"), grid.parent(F.col("c"), 8).alias("c")).agg(F.sum("v").alias("v"))
    return sparse.expand_uniform(coarse, v.mask().where("support"), 8).withColumn("v", F.round("v", 6))


_ROC = """
, g AS (SELECT {score} AS s, count(*) FILTER ({pos}) AS p, count(*) FILTER (NOT ({pos})) AS q FROM {source} GROUP BY {score}),
x AS (SELECT s, p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bq, sum(p) OVER (ORDER BY s DESC) AS ap, sum(p + q) OVER (ORDER BY s DESC) AS an, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM g)
SELECT round(sum(p * (bq + q / 2.0)) / (max(tp) * max(tq)), 6) AS auc, round(sum(p / tp * ap / an), 6) AS average_precision, cast(max(tp) AS bigint) AS positives, cast(max(tq) AS bigint) AS negatives FROM x
"""


@query("binary_roc_ap", _ROC.format(score="v", pos="inside", source="dense"))
def binary_roc_ap(v: Views):
    return ranking.roc_and_precision(v.dense(), "v", "inside")


@query("text_length_roc", _ROC.format(score="cast(n_chars AS double)", pos="quality = 1", source="(SELECT n_chars, quality FROM documents JOIN labels USING (doc_id))"))
def text_length_roc(v: Views):
    met = v.table("documents").select("doc_id", "n_chars").join(v.table("labels").select("doc_id", "quality"), "doc_id")
    return ranking.roc_and_precision(met.withColumn("good", F.col("quality") == 1), "n_chars", "good")


@query("distribution_distance", """
, t AS (SELECT r, c, sum(a) AS a, sum(b) AS b FROM al GROUP BY r, c), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM t)
SELECT round(sum(abs(p - q)) / 2, 6) AS tv, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM p
""")
def distribution_distance(v: Views):
    return ranking.distribution_distance(sparse.axis_totals(v.matrix("A"), v.matrix("R"), ["r", "c"]), "a", "b")


@query("spearman_axes", """
, t AS (SELECT r, c, sum(a) AS a, sum(b) AS b FROM al GROUP BY r, c),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM t)
SELECT cast(count(*) AS bigint) AS n, round(corr(x, y), 6) AS spearman FROM k
""")
def spearman_axes(v: Views):
    both = sparse.axis_totals(v.matrix("A"), v.matrix("R"), ["r", "c"])
    ranked = ranking.average_ranks(ranking.average_ranks(both, "a", "x"), "b", "y")
    return ranked.agg(*S.moments(F.col("x"), F.col("y"))).select("n", F.round(S.pearson_equal1(), 6).alias("spearman"))


@query("rank_deciles", """
, i AS (SELECT r, c, v, row_number() OVER (ORDER BY v, r * 100000 + c) - 1 AS i, count(*) OVER () AS n FROM field)
SELECT decile, cast(count(*) AS bigint) AS cells, sum(v) AS mass, min(v) AS least, max(v) AS most FROM (SELECT v, least(9, i * 10 // n) AS decile FROM i) GROUP BY decile
""")
def rank_deciles(v: Views):
    placed = ranking.rank_deciles(v.field().withColumn("key", F.col("r") * 100000 + F.col("c")), "v", "key")
    return placed.groupBy("decile").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("mass"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("topk_concentration", """
SELECT 100 AS k, round((SELECT sum(v) FROM (SELECT v FROM field ORDER BY v DESC, r * 100000 + c LIMIT 100)) / sum(v), 6) AS share FROM field
""")
def topk_concentration(v: Views):
    return ranking.concentration(v.field().withColumn("key", F.col("r") * 100000 + F.col("c")), "v", "key", 100)


@query("topk_overlap", """
, t AS (SELECT r * 100000 + c AS k, sum(a) AS a, sum(b) AS b FROM al GROUP BY r * 100000 + c)
SELECT cast(count(*) AS bigint) AS common FROM (SELECT k FROM t ORDER BY a DESC, k LIMIT 200) x JOIN (SELECT k FROM t ORDER BY b DESC, k LIMIT 200) y USING (k)
""")
def topk_overlap(v: Views):
    both = sparse.axis_totals(v.matrix("A"), v.matrix("R"), ["r", "c"]).withColumn("k", F.col("r") * 100000 + F.col("c"))
    top = lambda c: ranking.top_k(both, c, "k", 200).select("k")
    return top("a").join(top("b"), "k").agg(F.count(F.lit(1)).alias("common"))


@query("parent_support", """
, p AS (SELECT r // 8 AS pr, c // 8 AS pc, sum(v) / count(*) AS density, avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS fraction FROM dense GROUP BY r // 8, c // 8)
SELECT cast(count(*) AS bigint) AS parents, round(corr(density, fraction), 6) AS pearson FROM p
""")
def parent_support(v: Views):
    p = v.dense().groupBy(grid.parent(F.col("r"), 8).alias("pr"), grid.parent(F.col("c"), 8).alias("pc")).agg((F.sum("v") / F.count(F.lit(1))).alias("density"), F.avg(F.col("inside").cast("double")).alias("fraction"))
    return p.agg(*S.moments(F.col("density"), F.col("fraction"))).select(F.col("n").alias("parents"), F.round(S.pearson_zero(), 6).alias("pearson"))


@query("fine_scale_support", """
, p AS (SELECT *, r // 8 AS pr, c // 8 AS pc, max(v) OVER (PARTITION BY r // 8, c // 8) AS most FROM dense),
g AS (SELECT pr, pc, sum(v) AS mass, sum(v) FILTER (inside) AS sup, count(*) FILTER (inside) AS ns, count(*) FILTER (NOT inside) AS ne, count(*) FILTER (v = most) AS tied, count(*) FILTER (v = most AND NOT inside) AS tied_empty FROM p GROUP BY pr, pc)
SELECT pr, pc, round(sup / mass, 6) AS share, round((sup / ns - (mass - sup) / ne) / mass, 6) AS density_delta, tied = 1 AND tied_empty = 1 AS unique_on_empty, round(tied_empty / tied, 6) AS tie_share FROM g WHERE ns > 0 AND ne > 0 AND mass > 0
""")
def fine_scale_support(v: Views):
    d = v.dense().withColumn("pr", grid.parent(F.col("r"), 8)).withColumn("pc", grid.parent(F.col("c"), 8))
    most = d.withColumn("most", F.max("v").over(Window.partitionBy("pr", "pc")))  # 64 cells a parent
    n = lambda x: F.sum(x.cast("long"))
    peak = F.col("v") == F.col("most")
    g = most.groupBy("pr", "pc").agg(F.sum("v").alias("mass"), F.sum(F.when(F.col("inside"), F.col("v")).otherwise(0.0)).alias("sup"), n(F.col("inside")).alias("ns"), n(~F.col("inside")).alias("ne"), n(peak).alias("tied"), n(peak & ~F.col("inside")).alias("te"))
    delta = (F.col("sup") / F.col("ns") - (F.col("mass") - F.col("sup")) / F.col("ne")) / F.col("mass")
    return g.where("ns > 0 and ne > 0 and mass > 0").select("pr", "pc", F.round(F.col("sup") / F.col("mass"), 6).alias("share"), F.round(delta, 6).alias("density_delta"), ((F.col("tied") == 1) & (F.col("te") == 1)).alias("unique_on_empty"), F.round(F.col("te") / F.col("tied"), 6).alias("tie_share"))


_PATCH = ", g AS (SELECT feature_id, (r // 8) * 1000 + c // 8 AS patch, sum(a) AS a, sum(b) AS b FROM al GROUP BY ALL), n AS (SELECT feature_id, patch, ln(1 + 10000 * a / sum(a) OVER (PARTITION BY patch)) AS x, ln(1 + 10000 * b / sum(b) OVER (PARTITION BY patch)) AS y FROM g), f AS (SELECT coalesce(n.x, 0) AS x, coalesce(n.y, 0) AS y, k.feature_id, k.patch FROM (SELECT DISTINCT g1.feature_id, g2.patch FROM g g1, g g2) k LEFT JOIN n ON n.feature_id = k.feature_id AND n.patch = k.patch)"


def _patches(v: Views):
    """Gene by patch log-normalised values of both methods, over all genes and patches."""
    g = sparse.align(v.matrix("A"), v.matrix("R")).groupBy("feature_id", (grid.parent(F.col("r"), 8) * 1000 + grid.parent(F.col("c"), 8)).alias("patch")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = g.groupBy("patch").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    log = lambda x, t: F.log1p(1e4 * S.safe_fraction(F.col(x), F.col(t)))
    n = g.join(total, "patch").select("feature_id", "patch", log("a", "ta").alias("x"), log("b", "tb").alias("y"))
    axes = n.select("feature_id").distinct().crossJoin(n.select("patch").distinct())  # features by patches is the dense matrix itself
    return axes.join(n, ["feature_id", "patch"], "left").fillna(0.0, ["x", "y"])


@query("log_normalize", _PATCH + " SELECT feature_id, patch, round(x, 6) AS x, round(y, 6) AS y FROM f")
def log_normalize(v: Views):
    return _patches(v).select("feature_id", "patch", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("rowwise_pearson", _PATCH + " SELECT feature_id, cast(count(*) AS bigint) AS n, round(corr(x, y), 6) AS pearson FROM f GROUP BY feature_id")
def rowwise_pearson(v: Views):
    return _patches(v).groupBy("feature_id").agg(*S.moments(F.col("x"), F.col("y"))).select("feature_id", "n", F.round(S.pearson_null(), 6).alias("pearson"))


@query("zscore_markers", _PATCH + " SELECT feature_id, patch, round(CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END, 5) AS z FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM f WINDOW w AS (PARTITION BY feature_id))")
def zscore_markers(v: Views):
    d = _patches(v)
    stat = d.groupBy("feature_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return d.join(stat, "feature_id").select("feature_id", "patch", F.round(F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.when(F.col("s") > 0, F.col("s"))), F.lit(0.0)), 5).alias("z"))


@query("reliability", _PATCH + ", q AS (SELECT feature_id, corr(x, y) AS k FROM f GROUP BY feature_id) SELECT feature_id, round(CASE WHEN k IS NULL OR k <= -0.999999 THEN 0 ELSE greatest(0, least(1, 2 * k / (1 + k))) END, 6) AS reliability FROM q")
def reliability(v: Views):
    k = _patches(v).groupBy("feature_id").agg(*S.moments(F.col("x"), F.col("y"))).select("feature_id", S.pearson_null().alias("k"))
    boosted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * F.col("k"), 1 + F.col("k"))))
    return k.select("feature_id", F.round(F.when(F.col("k").isNull() | (F.col("k") <= -0.999999), F.lit(0.0)).otherwise(boosted), 6).alias("reliability"))


@query("marker_topn", """
, s AS (SELECT feature_id, (r // 16) * 1000 + c // 16 AS cluster, sum(v) AS v FROM ma GROUP BY ALL), t AS (SELECT *, v / avg(v) OVER (PARTITION BY feature_id) AS fold FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(fold * ln(1 + v), 9) DESC, v DESC, feature_id) AS place FROM t)
SELECT cluster, place, feature_id, v FROM k WHERE place <= 5
""")
def marker_topn(v: Views):
    s = v.matrix("A").groupBy("feature_id", (grid.parent(F.col("r"), 16) * 1000 + grid.parent(F.col("c"), 16)).alias("cluster")).agg(F.sum("v").alias("v"))
    mean = s.groupBy("feature_id").agg(F.avg("v").alias("m"))
    score = F.round(F.col("v") / F.col("m") * F.log1p("v"), 9)
    w = Window.partitionBy("cluster").orderBy(score.desc(), F.desc("v"), "feature_id")
    return s.join(mean, "feature_id").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("cluster", "place", "feature_id", "v")


_CURVE = ", t AS (SELECT feature_id, sum(a) AS a, sum(b) AS b FROM al GROUP BY feature_id), k AS (SELECT row_number() OVER (ORDER BY a DESC, feature_id) AS place, sum(a) OVER (ORDER BY a DESC, feature_id) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY a DESC, feature_id) / sum(b) OVER () AS y FROM t)"


def _curve(v: Views):
    """Running shares of both methods' mass over features in the order of the first; a row per feature."""
    t = sparse.axis_totals(v.matrix("A"), v.matrix("R"), ["feature_id"])
    all_ = t.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    o = Window.orderBy(F.desc("a"), "feature_id")
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    return t.crossJoin(F.broadcast(all_)).select(F.row_number().over(o).cast("long").alias("place"), (F.sum("a").over(run) / F.col("all_a")).alias("x"), (F.sum("b").over(run) / F.col("all_b")).alias("y"))


@query("coverage_curve", _CURVE + " SELECT place, round(x, 6) AS x, round(y, 6) AS y FROM k")
def coverage_curve(v: Views):
    return _curve(v).select("place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("trapezoid_auc", _CURVE + ", d AS (SELECT (place - lag(place) OVER (ORDER BY place)) * (y + lag(y) OVER (ORDER BY place)) / 2 AS piece, place FROM k) SELECT round(sum(piece) / (max(place) - min(place)), 6) AS auc FROM d")
def trapezoid_auc(v: Views):
    o = Window.orderBy("place")
    piece = (F.col("place") - F.lag("place").over(o)) * (F.col("y") + F.lag("y").over(o)) / 2
    return _curve(v).select(piece.alias("piece"), "place").agg(F.round(F.sum("piece") / (F.max("place") - F.min("place")), 6).alias("auc"))


@query("protein_quantile_auc", """
, x AS (SELECT r, c, sum(a) AS rna, sum(b) AS protein FROM al GROUP BY r, c), h AS (SELECT quantile_cont(protein, 0.8) AS q FROM x),
g AS (SELECT rna AS s, count(*) FILTER (protein >= q) AS p, count(*) FILTER (protein < q) AS n FROM x, h GROUP BY rna),
y AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn FROM g)
SELECT (SELECT q FROM h) AS threshold, round(sum(p * (bn + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM y
""")
def protein_quantile_auc(v: Views):
    x = sparse.axis_totals(v.matrix("A"), v.matrix("R"), ["r", "c"])
    q = quantiles(x, [], "b", q=0.8)
    marked = x.crossJoin(F.broadcast(q)).withColumn("positive", F.col("b") >= F.col("q"))
    return ranking.roc_and_precision(marked, "a", "positive").crossJoin(F.broadcast(q)).select(F.col("q").alias("threshold"), "auc")


@query("binary_mask_metrics", """
, x AS (SELECT inside AS a, v >= (SELECT quantile_cont(v, 0.6) FROM dense) AS b FROM dense)
SELECT cast(count(*) FILTER (a AND b) AS bigint) AS tp, cast(count(*) FILTER (NOT a AND b) AS bigint) AS fp, cast(count(*) FILTER (a AND NOT b) AS bigint) AS fn,
  round(count(*) FILTER (a AND b) / count(*) FILTER (b), 6) AS precision, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) AS recall,
  round(2 * count(*) FILTER (a AND b) / (count(*) FILTER (a) + count(*) FILTER (b)), 6) AS dice FROM x
""")
def binary_mask_metrics(v: Views):
    d = v.dense()
    q = quantiles(d, [], "v", q=0.6)
    a, b = F.col("inside"), F.col("v") >= F.col("q")
    n = lambda x: F.sum(x.cast("long"))
    got = d.crossJoin(F.broadcast(q)).agg(n(a & b).alias("tp"), n(~a & b).alias("fp"), n(a & ~b).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select("tp", "fp", "fn", F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("dice"))


@query("cell_aggregate", """
, l AS (SELECT r, c, (r // 5) * 13 + c // 5 AS label FROM mask WHERE inside)
SELECT feature_id, label, sum(v) AS v FROM ma JOIN l USING (r, c) GROUP BY feature_id, label
""")
def cell_aggregate(v: Views):
    cells = v.mask().where("inside").select("r", "c", (grid.parent(F.col("r"), 5) * 13 + grid.parent(F.col("c"), 5)).alias("label"))
    return sparse.aggregate_cells(v.matrix("A"), cells)


@query("profile_correlations", """
, l AS (SELECT r, c, (r // 16) * 1000 + c // 16 AS label FROM mask WHERE inside), x AS (SELECT feature_id, label, sum(a) AS a, sum(b) AS b FROM al JOIN l USING (r, c) GROUP BY ALL),
k AS (SELECT f.feature_id, q.label, ln(1 + coalesce(a, 0)) AS x, ln(1 + coalesce(b, 0)) AS y FROM (SELECT DISTINCT feature_id FROM al) f CROSS JOIN (SELECT DISTINCT label FROM x) q LEFT JOIN x ON x.feature_id = f.feature_id AND x.label = q.label)
SELECT label, round(corr(x, y), 6) AS pearson FROM k GROUP BY label
""")
def profile_correlations(v: Views):
    cells = v.mask().where("inside").select("r", "c", (grid.parent(F.col("r"), 16) * 1000 + grid.parent(F.col("c"), 16)).alias("label"))
    d = sparse.align(v.matrix("A"), v.matrix("R"))
    genes = d.select("feature_id").distinct().agg(F.count(F.lit(1)).alias("genes"))
    x = d.join(cells, ["r", "c"]).groupBy("feature_id", "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    m = x.groupBy("label").agg(*S.moments(F.log1p("a"), F.log1p("b"))).drop("n")
    return m.crossJoin(F.broadcast(genes)).withColumnRenamed("genes", "n").select("label", F.round(S.pearson_null(), 6).alias("pearson"))  # zeros count through n

"""Queries on registration surfaces, priors, panels and read-level audits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import grid, raster
from ..operators.registration import block_draws
from ..operators.tiles import met_sums
from ..operators.transforms import squared_distances
from .registry import query
from .views import Views

_SURFACE = ", sf AS (SELECT dy, dx, sum(b.v) / count(*) AS m FROM range(-5, 6) y(dy), range(-5, 6) x(dx), dense a JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx WHERE a.inside AND b.support GROUP BY dy, dx)"


def _surface(v: Views):
    return raster.shift_surface(v.dense(), 5).select("dy", "dx", F.try_divide("total", "n").alias("m"))


@query("ring_contrast", _SURFACE + " SELECT round(max(m) FILTER (dy = 0 AND dx = 0), 6) AS centre, round(median(m) FILTER (greatest(abs(dy), abs(dx)) BETWEEN 3 AND 5), 6) AS ring, round(1 - max(m) FILTER (dy = 0 AND dx = 0) / median(m) FILTER (greatest(abs(dy), abs(dx)) BETWEEN 3 AND 5), 6) AS contrast FROM sf")
def ring_contrast(v: Views):
    s = _surface(v)
    far = F.greatest(F.abs("dy"), F.abs("dx"))
    got = s.agg(F.max(F.when(far == 0, F.col("m"))).alias("c"), F.percentile(F.when(far.between(3, 5), F.col("m")), F.lit(0.5)).alias("k"))
    return got.select(F.round("c", 6).alias("centre"), F.round("k", 6).alias("ring"), F.round(1 - F.try_divide("c", "k"), 6).alias("contrast"))


@query("dip_depths", _SURFACE + """
, n AS (SELECT a.dy, a.dx, a.m, min(b.m) AS least, median(b.m) AS mid, count(*) AS k FROM sf a JOIN sf b ON abs(a.dy - b.dy) <= 1 AND abs(a.dx - b.dx) <= 1 AND NOT (a.dy = b.dy AND a.dx = b.dx) GROUP BY a.dy, a.dx, a.m)
SELECT dy, dx, round(1 - m / mid, 6) AS depth FROM n WHERE k = 8 AND m < least
""")
def dip_depths(v: Views):
    """Strict local minima of the surface and how far they lie under their neighbours' median."""
    s = _surface(v)
    near = grid.with_shifts(s.select(F.col("dy").alias("y"), F.col("dx").alias("x"), F.col("m").alias("o")), 1).where("dy <> 0 or dx <> 0")
    stat = near.groupBy((F.col("y") + F.col("dy")).alias("dy"), (F.col("x") + F.col("dx")).alias("dx")).agg(F.min("o").alias("least"), F.percentile("o", F.lit(0.5)).alias("mid"), F.count(F.lit(1)).alias("k"))
    return s.join(stat, ["dy", "dx"]).where("k = 8 and m < least").select("dy", "dx", F.round(1 - F.try_divide("m", "mid"), 6).alias("depth"))


@query("region_surfaces", """
, k AS (SELECT a.r // 16 AS br, a.c // 16 AS bc, dy, dx, sum(b.v) / count(*) AS m FROM range(-2, 3) y(dy), range(-2, 3) x(dx), dense a JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx WHERE a.inside AND b.support GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY br, bc ORDER BY round(m, 9) DESC, greatest(abs(dy), abs(dx)), dy, dx) AS place FROM k)
SELECT br, bc, dy, dx, round(m, 6) AS m FROM o WHERE place = 1
""")
def region_surfaces(v: Views):
    """Best shift of every region in one pass over all of them."""
    d = v.dense()
    mask = d.where("inside").select("r", "c", grid.parent(F.col("r"), 16).alias("br"), grid.parent(F.col("c"), 16).alias("bc"))
    m = met_sums(mask, d.where("support").withColumn("y", F.col("v")), 2, ["br", "bc"], v=(0, 1)).withColumn("m", F.col("v") / F.col("n"))
    order = F.struct((-F.round("m", 9)).alias("high"), F.greatest(F.abs("dy"), F.abs("dx")).alias("far"), "dy", "dx", "m")
    return m.groupBy("br", "bc").agg(F.min(order).alias("b")).select("br", "bc", "b.dy", "b.dx", F.round("b.m", 6).alias("m"))


@query("bootstrap_surface")
def bootstrap_surface(v: Views):
    """Shares of 200 draws of blocks whose best shift is within one cell of the whole surface's; draws are numpy's."""
    d, across = v.dense(), -(-v.side // 16)
    mask = d.where("inside").select("r", "c", (grid.parent(F.col("r"), 16) * across + grid.parent(F.col("c"), 16)).alias("block"))
    stat = met_sums(mask, d.where("support").withColumn("y", F.col("v")), 2, ["block"], s=(0, 1))
    draws = block_draws(across * across, 200, 11)  # a number per draw and block of the grid
    weights = v.spark.createDataFrame([(int(k), int(b), int(w)) for k, row in enumerate(draws) for b, w in enumerate(row) if w], "draw long, block long, w long")
    drawn = stat.join(F.broadcast(weights), "block").groupBy("draw", "dy", "dx").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    whole = stat.groupBy("dy", "dx").agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.max_by(F.struct(F.col("dy").alias("y"), F.col("dx").alias("x")), F.struct("m", "dy", "dx")).alias("w"))
    best = drawn.groupBy("draw").agg(F.max_by(F.struct("dy", "dx"), F.struct("m", "dy", "dx")).alias("b"))
    near = F.greatest(F.abs(F.col("b.dy") - F.col("w.y")), F.abs(F.col("b.dx") - F.col("w.x"))) <= 1
    return best.crossJoin(F.broadcast(whole)).agg(F.count(F.lit(1)).alias("draws"), F.avg(near.cast("double")).alias("stable"))


@query("edge_profile", """
, o AS (SELECT dy, dx, dy * dy + dx * dx AS d2 FROM range(-5, 6) y(dy), range(-5, 6) x(dx) WHERE dy * dy + dx * dx <= 25),
n AS (SELECT a.r, a.c, a.v, min(d2) AS d2 FROM dense a JOIN o ON true JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx AND NOT b.support WHERE a.support GROUP BY a.r, a.c, a.v)
SELECT CASE WHEN d2 <= 1 THEN 1 WHEN d2 <= 4 THEN 2 WHEN d2 <= 9 THEN 3 ELSE 5 END AS upto, cast(count(*) AS bigint) AS cells, round(avg(v), 6) AS density FROM n GROUP BY 1
""")
def edge_profile(v: Views):
    d = v.dense()
    near = d.where("support").join(squared_distances(d.withColumn("off", ~F.col("support")), ["off"]).where("d2_off <= 25").withColumnRenamed("d2_off", "d2"), ["r", "c"])
    upto = F.when(F.col("d2") <= 1, 1).when(F.col("d2") <= 4, 2).when(F.col("d2") <= 9, 3).otherwise(5)
    return near.groupBy(upto.alias("upto")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("v"), 6).alias("density"))


@query("broad_prior", """
, u AS (SELECT read_id, min(r // 2) AS pr, min(c // 2) AS pc FROM post GROUP BY read_id HAVING count(*) = 1), f AS (SELECT pr, pc, count(*) AS n FROM u GROUP BY pr, pc)
SELECT p.read_id, p.candidate, round(ln(coalesce(n, 0) - CASE WHEN u.read_id IS NOT NULL THEN 1 ELSE 0 END + 0.5), 6) AS log_prior FROM post p LEFT JOIN f ON f.pr = p.r // 2 AND f.pc = p.c // 2 LEFT JOIN u ON u.read_id = p.read_id
""")
def broad_prior(v: Views):
    """Log prior of each candidate from strict counts of its parent, its own contribution left out."""
    p = v.posteriors().select("read_id", "candidate", grid.parent(F.col("r"), 2).alias("pr"), grid.parent(F.col("c"), 2).alias("pc"))
    strict = p.groupBy("read_id").agg(F.count(F.lit(1)).alias("k"), F.min("pr").alias("pr"), F.min("pc").alias("pc")).where("k = 1")
    field = strict.groupBy("pr", "pc").agg(F.count(F.lit(1)).alias("n"))
    met = p.join(field, ["pr", "pc"], "left").join(strict.select("read_id", F.lit(1).alias("own")), "read_id", "left")
    return met.select("read_id", "candidate", F.round(F.ln(F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0)) + 0.5), 6).alias("log_prior"))


@query("molecule_rows", """
, k AS (SELECT read_id, feature_id, umi, arg_max(candidate, (round(p, 9), -r, -c)) AS unit, count(*) AS n FROM post GROUP BY ALL)
SELECT feature_id, umi, unit, cast(count(*) AS bigint) AS member_reads, cast(max(n) AS bigint) AS most_candidates, substr(sha256(string_agg(read_id, chr(31) ORDER BY read_id)), 1, 24) AS molecule_id FROM k GROUP BY ALL
""")
def molecule_rows(v: Views):
    """Hard calls grouped to molecules, with the digest of their reads."""
    p = v.posteriors()
    best = p.groupBy("read_id", "feature_id", "umi").agg(F.max_by("candidate", F.struct(F.round("p", 9).alias("p"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("unit"), F.count(F.lit(1)).alias("n"))
    g = best.groupBy("feature_id", "umi", "unit").agg(F.count(F.lit(1)).alias("member_reads"), F.max("n").alias("most_candidates"), F.sort_array(F.collect_list("read_id")).alias("reads"))
    return g.select("feature_id", "umi", "unit", "member_reads", "most_candidates", S.stable_id(F.array_join("reads", "\x1f")).alias("molecule_id"))


@query("shape_signatures", """
, s AS (SELECT read_id, string_agg(DISTINCT e, ';' ORDER BY e) AS shapes FROM (SELECT read_id, (r % 3) || '+' || (c % 3) AS e FROM cand) GROUP BY read_id)
SELECT shapes, cast(count(*) AS bigint) AS reads FROM s GROUP BY shapes
""")
def shape_signatures(v: Views):
    e = F.concat((F.col("r") % 3).cast("string"), F.lit("+"), (F.col("c") % 3).cast("string"))
    s = v.candidates().groupBy("read_id").agg(F.array_join(F.sort_array(F.collect_set(e)), ";").alias("shapes"))
    return s.groupBy("shapes").agg(F.count(F.lit(1)).alias("reads"))


@query("probe_panel", """
SELECT p_brand AS gene, cast(count(*) AS bigint) AS probes, bool_or(p_size > 5) AND NOT bool_or(p_size > 49) AS eligible FROM part GROUP BY p_brand
""", prelude=False)
def probe_panel(v: Views):
    keep, drop = F.col("p_size") > 5, F.col("p_size") > 49
    return v.table("part").groupBy(F.col("p_brand").alias("gene")).agg(F.count(F.lit(1)).alias("probes"), (F.bool_or(keep) & ~F.bool_or(drop)).alias("eligible"))


@query("suffix_overlap", """
, s AS (SELECT s_suppkey AS a, substr(md5(s_name), 2, 2) AS k FROM supplier), p AS (SELECT p_partkey AS b, substr(md5(p_name), 1, 2) AS k FROM part)
SELECT a, cast(count(*) AS bigint) AS partners FROM s JOIN p USING (k) GROUP BY a
""")
def suffix_overlap(v: Views):
    """Partners by a short key, counted per key before they meet."""
    s = v.table("supplier").select(F.col("s_suppkey").alias("a"), F.substring(F.md5("s_name"), 2, 2).alias("k"))
    p = v.table("part").groupBy(F.substring(F.md5("p_name"), 1, 2).alias("k")).agg(F.count(F.lit(1)).alias("partners"))
    return s.join(p, "k").select("a", "partners")


@query("histogram_percentiles", """
, h AS (SELECT cast(v AS bigint) // 50 AS b, count(*) AS n FROM field GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS upto, sum(n) OVER () AS total FROM h)
SELECT q, cast(min(b) AS bigint) AS bin FROM c, (SELECT unnest([0.1, 0.5, 0.9]) AS q) WHERE upto >= q * total GROUP BY q
""")
def histogram_percentiles(v: Views):
    """Percentile bins of a fixed-width histogram; the window runs over its bins."""
    h = v.field().groupBy(F.floor(F.col("v") / 50).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    c = h.withColumn("upto", F.sum("n").over(Window.orderBy("b"))).crossJoin(F.broadcast(total))
    q = c.withColumn("q", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).where(F.col("upto") >= F.col("q") * F.col("total"))
    return q.groupBy("q").agg(F.min("b").alias("bin"))


@query("patch_weighted_pearson", """
, g AS (SELECT feature_id, r // 16 * 1000 + c // 16 AS patch, sum(a) AS a, sum(b) AS b FROM al GROUP BY ALL), w AS (SELECT feature_id, sum(a + b) AS w FROM al GROUP BY feature_id),
m AS (SELECT patch, sum(w) AS n, sum(w * a) AS sx, sum(w * b) AS sy, sum(w * a * a) AS sxx, sum(w * b * b) AS syy, sum(w * a * b) AS sxy FROM g JOIN w USING (feature_id) GROUP BY patch)
SELECT patch, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS pearson FROM m
""")
def patch_weighted_pearson(v: Views):
    from ..operators import sparse

    al = sparse.align(v.matrix("A"), v.matrix("R"))
    g = al.groupBy("feature_id", (grid.parent(F.col("r"), 16) * 1000 + grid.parent(F.col("c"), 16)).alias("patch")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = al.groupBy("feature_id").agg(F.sum(F.col("a") + F.col("b")).alias("w"))
    x, y, k = F.col("a"), F.col("b"), F.col("w")
    m = g.join(w, "feature_id").groupBy("patch").agg(F.sum(k).alias("n"), F.sum(k * x).alias("sx"), F.sum(k * y).alias("sy"), F.sum(k * x * x).alias("sxx"), F.sum(k * y * y).alias("syy"), F.sum(k * x * y).alias("sxy"))
    return m.select("patch", F.round(S.pearson_null(), 6).alias("pearson"))


@query("serialization_residuals", """
, f AS (SELECT regr_slope(x, c) AS b, regr_intercept(x, c) AS a FROM (SELECT c, 2.5 * c + 7 + (r % 3) AS x FROM field))
SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(sqrt(avg(power(x - a - b * c, 2))), 6) AS rmse, round(max(abs(x - a - b * c)), 6) AS worst FROM f, (SELECT c, 2.5 * c + 7 + (r % 3) AS x FROM field) GROUP BY b, a
""")
def serialization_residuals(v: Views):
    d = v.field().select(F.col("c").cast("double").alias("c"), (2.5 * F.col("c") + 7 + F.col("r") % 3).alias("x"))
    m = d.agg(*S.moments(F.col("c"), F.col("x")))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = m.select(slope.alias("b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("a"))
    off = F.col("x") - F.col("a") - F.col("b") * F.col("c")
    got = d.crossJoin(F.broadcast(fit)).groupBy("b", "a").agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.max(F.abs(off)).alias("worst"))
    return got.select(F.round("b", 6).alias("slope"), F.round("a", 6).alias("intercept"), F.round("rmse", 6).alias("rmse"), F.round("worst", 6).alias("worst"))



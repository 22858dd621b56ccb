"""Queries on stacks of shift surfaces, affine fits of regions, and the check of a whole field."""

from pyspark.sql import functions as F

from ..operators import grid, raster
from ..operators import registration as R
from ..operators.tiles import met_sums
from .registry import query
from .views import Views

#: A surface per feature: what the mask covers at each shift.
_STACK = ", st AS (SELECT feature_id, dy, dx, sum(o.v) AS v FROM range(-4, 5) y(dy), range(-4, 5) x(dx), mask a JOIN mp o ON o.r = a.r + dy AND o.c = a.c + dx WHERE a.inside GROUP BY feature_id, dy, dx)"
_NEAR = ", nb AS (SELECT a.feature_id, a.dy, a.dx, a.v, min(b.v) AS least, max(b.v) AS most, median(b.v) AS middle, count(*) AS k FROM st a JOIN st b ON a.feature_id = b.feature_id AND abs(a.dy - b.dy) <= 1 AND abs(a.dx - b.dx) <= 1 AND NOT (a.dy = b.dy AND a.dx = b.dx) GROUP BY ALL)"


def _stack(v: Views):
    return met_sums(v.mask().where("inside"), v.matrix("A", "R").withColumn("y", F.col("v")), 4, on_b=["feature_id"], v=(0, 1)).drop("n")


_EXTREMES = _STACK + _NEAR + """
, h AS (SELECT *, CASE WHEN v < least THEN 'dip' ELSE 'peak' END AS kind, CASE WHEN v < least THEN 1 - v / middle ELSE v / middle - 1 END AS size FROM nb WHERE k = 8 AND greatest(abs(dy), abs(dx)) <= 3 AND (v < least OR v > most)),
b AS (SELECT *, row_number() OVER (PARTITION BY feature_id, kind ORDER BY size DESC, dy, dx) AS place FROM h),
ex AS (SELECT f.feature_id, k.kind, b.v IS NOT NULL AS found, dy, dx, size, v, middle FROM (SELECT DISTINCT feature_id FROM st) f CROSS JOIN (SELECT unnest(['dip', 'peak']) AS kind) k LEFT JOIN b ON b.feature_id = f.feature_id AND b.kind = k.kind AND place = 1)"""


@query("surface_extremes", _EXTREMES + """
SELECT feature_id, kind, found, dy, dx, round(size, 6) AS size, v AS value, middle AS neighbour_median, greatest(abs(dy), abs(dx)) = 3 AS boundary FROM ex
""")
def surface_extremes(v: Views):
    return R.extremes(_stack(v), ["feature_id"], 3).withColumn("size", F.round("size", 6))


@query("shift_agreement", _EXTREMES + """
, p AS (SELECT a.feature_id, CASE WHEN a.found AND b.found THEN greatest(abs(a.dy - b.dy), abs(a.dx - b.dx)) END AS apart, a.found AND a.dy = 0 AND a.dx = 0 AS zero FROM ex a JOIN ex b ON a.feature_id = b.feature_id AND a.kind = 'dip' AND b.kind = 'peak')
SELECT cast(count(*) AS bigint) AS surfaces, cast(count(apart) AS bigint) AS both, cast(count(*) FILTER (apart = 0) AS bigint) AS equal, cast(count(*) FILTER (apart = 1) AS bigint) AS off_by_one, cast(count(*) FILTER (zero) AS bigint) AS dip_at_zero, max(apart) AS farthest FROM p
""")
def shift_agreement(v: Views):
    """How far two features of each surface lie apart: equal, one location off, at zero, and the farthest."""
    e = R.extremes(_stack(v), ["feature_id"], 3)
    side = lambda kind, p: e.where(F.col("kind") == kind).select("feature_id", F.col("dy").alias(f"{p}y"), F.col("dx").alias(f"{p}x"), F.col("found").alias(f"{p}f"))
    apart = F.when(F.col("af") & F.col("bf"), R.chebyshev(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")))
    met = side("dip", "a").join(side("peak", "b"), "feature_id").select(apart.alias("apart"), (F.col("af") & (F.col("ay") == 0) & (F.col("ax") == 0)).alias("zero"))
    n = lambda c: F.count(F.when(c, 1))
    return met.agg(F.count(F.lit(1)).alias("surfaces"), F.count("apart").alias("both"), n(F.col("apart") == 0).alias("equal"), n(F.col("apart") == 1).alias("off_by_one"), n(F.col("zero")).alias("dip_at_zero"), F.max("apart").alias("farthest"))


@query("depth_at_zero", _STACK + _NEAR + " SELECT f.feature_id, round(CASE WHEN k = 8 AND middle > 0 THEN 1 - v / middle END, 6) AS depth FROM (SELECT DISTINCT feature_id FROM st) f LEFT JOIN nb ON nb.feature_id = f.feature_id AND dy = 0 AND dx = 0")
def depth_at_zero(v: Views):
    return R.depth_at(_stack(v), ["feature_id"], 0, 0).withColumn("depth", F.round("depth", 6))


@query("strongest_contrast", """
, sf AS (SELECT dy, dx, sum(b.v) / count(*) AS v FROM range(-7, 8) y(dy), range(-7, 8) x(dx), dense a JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx WHERE a.inside AND b.support GROUP BY dy, dx),
pr AS (SELECT a.dy, a.dx, greatest(abs(b.dy - a.dy), abs(b.dx - a.dx)) AS d, median(b.v) AS m FROM sf a JOIN sf b ON abs(b.dy - a.dy) <= 5 AND abs(b.dx - a.dx) <= 5 WHERE abs(a.dy) <= 2 AND abs(a.dx) <= 2 GROUP BY ALL),
rg AS (SELECT a.dy, a.dx, median(b.v) AS ring FROM sf a JOIN sf b ON greatest(abs(b.dy - a.dy), abs(b.dx - a.dx)) BETWEEN 3 AND 5 WHERE abs(a.dy) <= 2 AND abs(a.dx) <= 2 GROUP BY ALL),
ce AS (SELECT dy, dx, 1 - m / ring AS contrast, m AS mean, ring FROM pr JOIN rg USING (dy, dx) WHERE d = 0 AND ring > 0),
be AS (SELECT * FROM ce ORDER BY -abs(contrast), greatest(abs(dy), abs(dx)), dy, dx LIMIT 1)
SELECT be.dy, be.dx, round(contrast, 6) AS contrast, round(mean, 6) AS mean, round(ring, 6) AS reference, CASE WHEN contrast > 0 THEN 'dip' WHEN contrast < 0 THEN 'peak' ELSE 'flat' END AS sign, greatest(abs(be.dy), abs(be.dx)) = 2 AS border,
  min(CASE WHEN d > 0 AND ((ring > mean AND m >= (mean + ring) / 2) OR (ring < mean AND m <= (mean + ring) / 2)) THEN d * 2.0e0 END) AS width_um, round(max(m) FILTER (d = 5), 6) AS outermost
FROM be JOIN pr USING (dy, dx) GROUP BY ALL
""")
def strongest_contrast(v: Views):
    s = raster.shift_surface(v.dense(), 7).select("dy", "dx", F.try_divide("total", "n").alias("v"))
    got = R.strongest_contrast(s, 2)
    return got.select("dy", "dx", *(F.round(c, 6).alias(c) for c in ("contrast", "mean", "reference")), "sign", "border", "width_um", F.round(F.col("profile")[5], 6).alias("outermost"))


@query("optimum_lags", _STACK + """
, f AS (SELECT feature_id, arg_min((dy, dx), (v, dy, dx)) AS p, min(v) AS m FROM st GROUP BY feature_id),
l AS (SELECT f.feature_id, p[1] AS y, p[2] AS x, m, max(v) FILTER (dy = p[1] - 1 AND dx = p[2]) AS up, max(v) FILTER (dy = p[1] + 1 AND dx = p[2]) AS down, max(v) FILTER (dy = p[1] AND dx = p[2] - 1) AS lft, max(v) FILTER (dy = p[1] AND dx = p[2] + 1) AS rgt FROM f JOIN st USING (feature_id) GROUP BY ALL),
w AS (SELECT a.feature_id, a.dy, a.dx, a.v FROM st a JOIN st b ON a.feature_id = b.feature_id AND abs(a.dy - b.dy) <= 1 AND abs(a.dx - b.dx) <= 1 AND NOT (a.dy = b.dy AND a.dx = b.dx) GROUP BY ALL HAVING a.v <= min(b.v)),
nx AS (SELECT w.feature_id, arg_min((dy, dx, v), (v, greatest(abs(dy), abs(dx)), dy, dx)) AS n FROM w JOIN l ON l.feature_id = w.feature_id AND NOT (w.dy = y AND w.dx = x) GROUP BY w.feature_id)
SELECT l.feature_id, round(y + CASE WHEN up - 2 * m + down > 0 THEN least(0.5, greatest(-0.5, (up - down) / (2 * (up - 2 * m + down)))) ELSE 0 END, 6) AS dy, round(x + CASE WHEN lft - 2 * m + rgt > 0 THEN least(0.5, greatest(-0.5, (lft - rgt) / (2 * (lft - 2 * m + rgt)))) ELSE 0 END, 6) AS dx,
  y AS integer_dy, x AS integer_dx, m AS metric, greatest(abs(y), abs(x)) = 4 AS boundary, n[1] AS next_dy, n[2] AS next_dx, n[3] AS next_metric FROM l LEFT JOIN nx USING (feature_id)
""")
def optimum_lags(v: Views):
    return R.optimum(_stack(v), ["feature_id"]).withColumns({"dy": F.round("dy", 6), "dx": F.round("dx", 6)})


_BLUR = """
, w AS (SELECT k, exp(-0.5 * k * k / 4.0) / (SELECT sum(exp(-0.5 * j * j / 4.0)) FROM range(-8, 9) u(j)) AS w FROM range(-8, 9) t(k)),
ps AS (SELECT r, c, support, CASE WHEN inside AND support THEN 1.0 ELSE 0.0 END AS a, CASE WHEN support THEN ln(1 + v) ELSE 0.0 END AS b FROM dense),
b1 AS (SELECT r + k AS r, c, sum(a * w) AS a, sum(b * w) AS b FROM ps, w GROUP BY 1, 2), b2 AS (SELECT r, c + k AS c, sum(a * w) AS a, sum(b * w) AS b FROM b1, w GROUP BY 1, 2),
bp AS (SELECT ps.r, ps.c, CASE WHEN support THEN ps.a - b2.a ELSE 0 END AS a, CASE WHEN support THEN ps.b - b2.b ELSE 0 END AS b FROM ps JOIN b2 USING (r, c))"""


@query("bandpass", _BLUR + " SELECT r, c, round(a, 6) AS a, round(b, 6) AS b FROM bp")
def bandpass(v: Views):
    return R.prepared(v.dense(), 2.0).select("r", "c", *(F.round(F.col(k) + 0.0, 6).alias(k) for k in "ab"))


@query("registered_lag", _BLUR + """
, s AS (SELECT dy, dx, corr(x.a, y.b) AS m FROM range(-2, 3) u(dy), range(-2, 3) v(dx), bp x JOIN bp y ON y.r = x.r + dy AND y.c = x.c + dx GROUP BY dy, dx)
SELECT arg_min(dy, (round(m, 6), dy, dx)) AS integer_dy, arg_min(dx, (round(m, 6), dy, dx)) AS integer_dx, round(min(m), 6) AS metric, round(max(m) FILTER (dy = 0 AND dx = 0), 6) AS at_zero FROM s
""")
def registered_lag(v: Views):
    """The lag of the smallest correlation of mask and counts after the band-pass, and the value without a shift."""
    p = R.prepared(v.dense(), 2.0)
    s = raster.ncc_surface(p.select("r", "c", F.col("a").alias("v")), p.select("r", "c", F.col("b").alias("v")), 2).select("dy", "dx", F.col("ncc").alias("v"))
    zero = s.where("dy = 0 and dx = 0").select(F.col("v").alias("at_zero"))
    return R.optimum(s.withColumn("one", F.lit(1)), ["one"]).crossJoin(F.broadcast(zero)).select("integer_dy", "integer_dx", F.round("metric", 6).alias("metric"), F.round("at_zero", 6).alias("at_zero"))


def _fit_sql(name: str, rows: str, where: str) -> str:
    """The affine fit of ``rows`` where a condition holds, with one rejection, in SQL: coefficients k0, ky, kx of dy and dx."""

    def solved(out: str, source: str, cond: str) -> str:
        sums = "count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(y * y) AS syy, sum(x * x) AS sxx, sum(y * x) AS syx, " + ", ".join(f"sum({k}) AS t_{k}, sum({k} * y) AS ty_{k}, sum({k} * x) AS tx_{k}" for k in ("dy", "dx"))
        minors = "syy * sxx - syx * syx AS m0, sx * syx - sy * sxx AS m1, sy * syx - sx * syy AS m2, n * sxx - sx * sx AS m3, sx * sy - n * syx AS m4, n * syy - sy * sy AS m5"
        size = "n * m0 + sy * m1 + sx * m2"
        coef = ", ".join(f"CASE WHEN n >= 3 AND {size} > 1e-9 * n * syy * sxx THEN (m{a} * t_{k} + m{b} * ty_{k} + m{c} * tx_{k}) / ({size}) END AS k{p}_{k}" for k in ("dy", "dx") for p, a, b, c in (("0", 0, 1, 2), ("y", 1, 3, 4), ("x", 2, 4, 5)))
        return f", {out}_s AS (SELECT feature_id, {sums} FROM {source} WHERE {cond} GROUP BY feature_id), {out} AS (SELECT feature_id, n, {coef} FROM (SELECT *, {minors} FROM {out}_s))"

    off = "greatest(abs(dy - (k0_dy + ky_dy * y + kx_dy * x)), abs(dx - (k0_dx + ky_dx * y + kx_dx * x)))"
    return solved(f"{name}_1", rows, where) + f", {name}_r AS (SELECT r.*, {off} AS off FROM {rows} r JOIN {name}_1 f USING (feature_id))" + solved(name, f"{name}_r", f"({where}) AND off <= 2")


_REGIONS = """
, cn AS (SELECT r // 16 AS br, c // 16 AS bc, avg(r) AS y, avg(c) AS x, count(*) AS cells FROM mask WHERE inside AND support GROUP BY ALL),
rs AS (SELECT feature_id, a.r // 16 AS br, a.c // 16 AS bc, dy, dx, sum(o.v) AS v FROM range(-2, 3) t1(dy), range(-2, 3) t2(dx), mask a JOIN mp o ON o.r = a.r + dy AND o.c = a.c + dx WHERE a.inside GROUP BY ALL),
rb AS (SELECT feature_id, br, bc, arg_max((dy, dx), (v, -dy, -dx)) AS p FROM rs GROUP BY ALL),
rg AS (SELECT feature_id, br AS row, bc AS col, p[1]::double AS dy, p[2]::double AS dx, y, x, cells >= 60 AS usable FROM rb JOIN cn USING (br, bc))"""


def _regions(v: Views):
    at = [grid.parent(F.col(k), 16).alias(f"b{k}") for k in "rc"]
    centres = v.mask().where("inside and support").groupBy(*at).agg(F.avg("r").alias("y"), F.avg("c").alias("x"), F.count(F.lit(1)).alias("cells"))
    met = met_sums(v.mask().where("inside").select("r", "c", *at), v.matrix("A", "R").withColumn("y", F.col("v")), 2, ["br", "bc"], ["feature_id"], v=(0, 1))
    best = met.groupBy("feature_id", "br", "bc").agg(F.min(F.struct((-F.col("v")).alias("low"), "dy", "dx")).alias("b"))
    return best.join(centres, ["br", "bc"]).select("feature_id", F.col("br").alias("row"), F.col("bc").alias("col"), F.col("b.dy").cast("double").alias("dy"), F.col("b.dx").cast("double").alias("dx"), "y", "x", (F.col("cells") >= 60).alias("usable"))


@query("affine_rejection", _REGIONS + _fit_sql("ft", "rg", "usable") + " SELECT feature_id, cast(n AS bigint) AS retained, round(k0_dy, 5) + 0e0 AS k0_dy, round(ky_dy, 5) + 0e0 AS ky_dy, round(kx_dy, 5) + 0e0 AS kx_dy, round(k0_dx, 5) + 0e0 AS k0_dx, round(ky_dx, 5) + 0e0 AS ky_dx, round(kx_dx, 5) + 0e0 AS kx_dx FROM ft")
def affine_rejection(v: Views):
    """Of every feature the displacement that varies with the place, fitted to its regions' best shifts."""
    got = R.affine_fit(_regions(v).where("usable"), ["feature_id"])
    return got.select("feature_id", F.col("retained").cast("long").alias("retained"), *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in R.COEFFICIENTS))


@query("affine_check", _REGIONS + ", us AS (SELECT * FROM rg WHERE usable)" + _fit_sql("tr", "us", "(row + col) % 2 = 0") + _fit_sql("fin", "us", "true") + """
, hd AS (SELECT u.feature_id, count(*) AS usable, count(*) FILTER ((row + col) % 2 = 1) AS held_out, count(*) FILTER ((row + col) % 2 = 1 AND greatest(abs(dy - (k0_dy + ky_dy * y + kx_dy * x)), abs(dx - (k0_dx + ky_dx * y + kx_dx * x))) <= 1) AS passed, coalesce(bool_or(k0_dy IS NOT NULL), false) AS trained FROM us u LEFT JOIN tr USING (feature_id) GROUP BY u.feature_id),
rn AS (SELECT hd.*, coalesce(fin.n, 0) AS retained, CASE WHEN NOT trained THEN 'too few positions to train' WHEN coalesce(passed / held_out, 0) < 0.75 THEN 'held-out prediction' WHEN k0_dy IS NULL THEN 'too few positions' WHEN fin.n < 12 THEN 'too few regions remain' END AS reason FROM hd LEFT JOIN fin USING (feature_id))
SELECT feature_id, cast(usable AS bigint) AS usable, cast(held_out AS bigint) AS held_out, cast(passed AS bigint) AS held_out_pass, cast(retained AS bigint) AS retained, reason IS NULL AS accepted, reason FROM rn
""")
def affine_check(v: Views):
    return R.affine_check(_regions(v), ["feature_id"]).select("feature_id", "usable", "held_out", "held_out_pass", "retained", "accepted", "reason")


_PARTS = """
, o AS (SELECT dy, dx, dy * dy + dx * dx AS d2 FROM range(-6, 7) y(dy), range(-6, 7) x(dx) WHERE dy * dy + dx * dx <= 36),
nn AS (SELECT a.r, a.c, a.inside, min(d2) FILTER (b.inside) AS di, min(d2) FILTER (NOT b.inside) AS dn FROM dense a, o JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY a.r, a.c, a.inside),
kb AS (SELECT r, c, CASE WHEN inside THEN CASE WHEN dn <= 1 THEN 2 WHEN dn <= 4 THEN 1 ELSE 0 END ELSE 2 + ceil(sqrt(di)) END::int AS band FROM nn WHERE inside OR di IS NOT NULL),
cv AS (SELECT a.r, a.c, a.v, sum(b.v) AS s, count(*) AS n FROM dense a JOIN dense b ON b.support AND b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 WHERE a.support GROUP BY a.r, a.c, a.v),
xv AS (SELECT r, c, r // (s.s // 2) AS row, c // (s.s // 2) AS col, CASE WHEN cv.s > 0 THEN v / (cv.s / n) ELSE 0 END AS v FROM cv, side s),
tt AS (SELECT row, col, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM xv GROUP BY ALL),
mbd AS (SELECT row, col, dy, dx, band, count(*) AS n, sum(v) AS s FROM range(-3, 4) y(dy), range(-3, 4) x(dx), xv JOIN kb ON kb.r = xv.r - dy AND kb.c = xv.c - dx GROUP BY ALL),
mt AS (SELECT row, col, dy, dx, sum(s * s / n) AS between, sum(n) AS n, sum(s) AS s FROM mbd GROUP BY ALL),
et AS (SELECT row, col, dy, dx, (between + CASE WHEN tt.n > mt.n THEN (tt.s - mt.s) * (tt.s - mt.s) / (tt.n - mt.n) ELSE 0 END - tt.s * tt.s / tt.n) / (tt.q - tt.s * tt.s / tt.n) AS v FROM mt JOIN tt USING (row, col)),
lm AS (SELECT a.row, a.col, a.dy, a.dx, a.v FROM et a JOIN et b ON a.row = b.row AND a.col = b.col AND abs(a.dy - b.dy) <= 1 AND abs(a.dx - b.dx) <= 1 AND NOT (a.dy = b.dy AND a.dx = b.dx) WHERE abs(a.dy) <= 2 AND abs(a.dx) <= 2 GROUP BY ALL HAVING count(*) = 8 AND a.v > max(b.v)),
bt AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY v DESC, dy, dx) AS place FROM lm),
sq AS (SELECT r // (s.s // 2) AS row, c // (s.s // 2) AS col, count(*) AS squares, avg(r) AS y, avg(c) AS x FROM mask, side s WHERE inside AND support GROUP BY ALL)
"""


@query("regional_registration", _PARTS + """
SELECT sq.row, sq.col, cast(squares AS bigint) AS squares, round(y, 6) AS centroid_y, round(x, 6) AS centroid_x, dy, dx, round(v, 6) AS eta2 FROM sq LEFT JOIN bt ON bt.row = sq.row AND bt.col = sq.col AND place = 1
""")
def regional_registration(v: Views):
    """The shift of each quarter of the grid; whether resamples agree is tested on planted shifts."""
    got = R.assess_regions(v.dense(), v.side, v.side, 2, 0, search=2, block=16, draws=1)
    return got.select("row", "col", "squares", F.round("centroid_y", 6).alias("centroid_y"), F.round("centroid_x", 6).alias("centroid_x"), "dy", "dx", F.round("eta2", 6).alias("eta2"))


@query("assess_field")
def assess_field(v: Views):
    """Whether the mask is registered to the counts, by resamples of blocks."""
    return R.assess(v.dense(), v.side, v.side, 3, 16, draws=60)


@query("homography_residual", "SELECT cast(count(*) AS bigint) AS points, 0e0 AS worst, 1.2e0 AS h00, 0e0 AS h20 FROM field", prelude=True)
def homography_residual(v: Views):
    """The map of cell centres to an image, fitted to all points and held against them."""
    points = v.field().select(R.grid_centres(F.col("c"), 8).alias("x"), R.grid_centres(F.col("r"), 8).alias("y"))
    seen = points.select("x", "y", (1.2 * F.col("x") - 0.1 * F.col("y") + 40).alias("u"), (0.1 * F.col("x") + 1.1 * F.col("y") + 25).alias("v"))
    h, worst = R.fit_homography(seen)
    return seen.agg(F.count(F.lit(1)).alias("points")).select("points", F.round(F.lit(worst), 5).alias("worst"), F.round(F.lit(float(h[0][0])), 5).alias("h00"), F.round(F.lit(abs(float(h[2][0]))), 5).alias("h20"))


@query("cyclic_displacement", """
, fa AS (SELECT r, c, sum(v) AS v FROM ma GROUP BY r, c), fb AS (SELECT r, c, sum(v) AS v FROM mb GROUP BY r, c)
SELECT dy, dx, sum(fa.v * fb.v) AS v FROM range(-2, 3) t1(dy), range(-2, 3) t2(dx), fa JOIN fb ON fb.r = (fa.r + dy + (SELECT s FROM side)) % (SELECT s FROM side) AND fb.c = (fa.c + dx + (SELECT s FROM side)) % (SELECT s FROM side) GROUP BY dy, dx
""")
def cyclic_displacement(v: Views):
    total = lambda m: v.matrix(m).groupBy("r", "c").agg(F.sum("v").alias("v"))
    return R.cyclic_displacement(total("A"), total("R"), v.side, 2)


@query("rectangle_sums", ", bx AS (SELECT cast(i AS bigint) AS box, i * 5 AS r0, i * 3 AS c0, i * 5 + 7 + i AS r1, i * 3 + 20 AS c1 FROM range(8) t(i)) SELECT box, count(r) FILTER (support)::bigint AS cells, coalesce(sum(v) FILTER (support), 0) AS mass FROM bx JOIN dense ON r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY box")
def rectangle_sums(v: Views):
    d = v.dense().withColumn("one", F.col("support").cast("long")).withColumn("mass", F.when(F.col("support"), F.col("v")).otherwise(0.0))
    i = F.col("id")
    boxes = v.spark.range(8).select(i.alias("box"), (i * 5).alias("r0"), (i * 3).alias("c0"), (i * 6 + 7).alias("r1"), (i * 3 + 20).alias("c1"))
    cells = R.rectangle_sums(R.integral(d, "one"), boxes).select("box", F.col("total").cast("long").alias("cells"))
    return cells.join(R.rectangle_sums(R.integral(d, "mass"), boxes).select("box", F.col("total").alias("mass")), "box")


@query("unsupported_parents", "SELECT f.r // 4 AS pr, f.c // 4 AS pc, sum(f.v) AS mass FROM field f WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.r // 4 = f.r // 4 AND m.c // 4 = f.c // 4 AND m.support AND (m.r * 5 + m.c * 3) % 7 = 0 AND m.inside) GROUP BY ALL")
def unsupported_parents(v: Views):
    """Coarse cells with counts and no supported child."""
    up = lambda d: d.withColumns({"pr": grid.parent(F.col("r"), 4), "pc": grid.parent(F.col("c"), 4)})
    kids = up(v.mask().where("support and inside and (r * 5 + c * 3) % 7 = 0")).select("pr", "pc").distinct()
    return up(v.field()).groupBy("pr", "pc").agg(F.sum("v").alias("mass")).join(kids, ["pr", "pc"], "left_anti")


@query("complete_parents", ", k AS (SELECT r // 4 AS pr, c // 4 AS pc, count(*) AS children, count(*) FILTER (v > 200) AS full_, sum(v) AS mass FROM field GROUP BY ALL) SELECT pr, pc, mass, round(full_ / 16, 6) AS share FROM k WHERE children = 16")
def complete_parents(v: Views):
    """Parents all of whose children are there, and the share of children above a count."""
    d = v.field().groupBy(grid.parent(F.col("r"), 4).alias("pr"), grid.parent(F.col("c"), 4).alias("pc"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("mass"), F.round(F.sum((F.col("v") > 200).cast("long")) / 16, 6).alias("share")).where("n = 16").drop("n")


@query("compartment_weights", """
, s AS (SELECT o.r // 4 AS pr, o.c // 4 AS pc, CASE WHEN inside THEN 'nucleus' WHEN support THEN 'cell' ELSE 'outside' END AS state, o.v FROM field o JOIN mask m ON m.r = o.r AND m.c = o.c)
SELECT pr, pc, cast(count(*) AS bigint) AS children, round(count(*) FILTER (state = 'nucleus') / count(*), 6) AS nucleus, round(count(*) FILTER (state = 'cell') / count(*), 6) AS cell, round(count(*) FILTER (state = 'outside') / count(*), 6) AS outside, sum(v) AS mass FROM s GROUP BY pr, pc
""")
def compartment_weights(v: Views):
    """Of every coarse cell the shares of its counted children in each compartment."""
    state = F.when(F.col("inside"), "nucleus").when(F.col("support"), "cell").otherwise("outside")
    d = v.field().join(v.mask(), ["r", "c"]).withColumn("state", state)
    part = lambda k: F.round(F.avg((F.col("state") == k).cast("double")), 6).alias(k)
    return d.groupBy(grid.parent(F.col("r"), 4).alias("pr"), grid.parent(F.col("c"), 4).alias("pc")).agg(F.count(F.lit(1)).alias("children"), part("nucleus"), part("cell"), part("outside"), F.sum("v").alias("mass"))

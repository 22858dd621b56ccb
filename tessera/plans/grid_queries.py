"""Queries on grid geometry, shifts and labels."""

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import grid, raster, transforms
from .registry import query
from .views import Views


@query("bin_parent_ids", """
, s AS (SELECT unnest([2, 8, 16]) AS size_um)
SELECT size_um, 's_' || lpad(size_um::varchar, 3, '0') || 'um_' || (r // (size_um // 2)) || '_' || (c // (size_um // 2)) AS unit, sum(v) AS mass FROM field, s GROUP BY ALL
""")
def bin_parent_ids(v: Views):
    f = v.field()
    units = F.explode(F.array(*(F.struct(F.lit(s).alias("size_um"), grid.bin_id(s, F.col("r"), F.col("c")).alias("unit")) for s in (2, 8, 16))))
    return f.withColumn("u", units).groupBy("u.size_um", "u.unit").agg(F.sum("v").alias("mass"))


@query("parse_bin_ids", "SELECT 's_002um_' || lpad(r::varchar, 5, '0') || '_' || lpad(c::varchar, 5, '0') || '-1' AS name, 2::bigint AS size_um, r, c FROM field")
def parse_bin_ids(v: Views):
    name = F.concat(F.lit("s_002um_"), F.lpad(F.col("r").cast("string"), 5, "0"), F.lit("_"), F.lpad(F.col("c").cast("string"), 5, "0"), F.lit("-1"))
    size, row, col = grid.parse_bin_id(F.col("name"))
    return v.field().select(name.alias("name")).select("name", size.alias("size_um"), row.alias("r"), col.alias("c"))


@query("distance_bands", """
, o AS (SELECT dy, dx, dy * dy + dx * dx AS d2 FROM range(-6, 7) y(dy), range(-6, 7) x(dx) WHERE dy * dy + dx * dx <= 36),
n AS (SELECT a.r, a.c, a.inside, a.v, min(d2) FILTER (b.inside) AS di, min(d2) FILTER (NOT b.inside) AS dn FROM dense a, o JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY a.r, a.c, a.inside, a.v),
k AS (SELECT CASE WHEN inside THEN CASE WHEN dn <= 1 THEN 2 WHEN dn <= 4 THEN 1 ELSE 0 END WHEN di IS NULL THEN -1 ELSE 2 + ceil(sqrt(di)) END::int AS band, v FROM n)
SELECT band, cast(count(*) AS bigint) AS cells, sum(v) AS mass, round(sum(v) / count(*), 6) AS density FROM k GROUP BY band
""")
def distance_bands(v: Views):
    return raster.distance_bands(v.dense()).groupBy("band").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("mass"), F.round(F.avg("v"), 6).alias("density"))


@query("box_mean_corrected", """
, b AS (SELECT a.r, a.c, a.v, a.support, sum(b.v) FILTER (b.support) AS s, count(*) FILTER (b.support) AS n FROM dense a JOIN dense b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.r, a.c, a.v, a.support)
SELECT r, c, round(CASE WHEN support AND s > 0 THEN v / (s / n) ELSE 0 END, 6) AS v FROM b
""")
def box_mean_corrected(v: Views):
    return raster.corrected(v.dense(), 2).select("r", "c", F.round("v", 6).alias("v"))


_LABELS = ", lab AS (SELECT r, c, cast(r * 100000 + c AS bigint) AS label FROM field WHERE r % 8 = 3 AND c % 8 = 5)"


def _labels(v: Views):
    return v.field().where("r % 8 = 3 and c % 8 = 5").select("r", "c", (F.col("r") * 100000 + F.col("c")).alias("label"))


@query("grow_labels", _LABELS + """
, k AS (SELECT m.r, m.c, label, (m.r - l.r) * (m.r - l.r) + (m.c - l.c) * (m.c - l.c) AS d2 FROM mask m JOIN lab l ON abs(m.r - l.r) <= 4 AND abs(m.c - l.c) <= 4)
SELECT r, c, arg_min(label, (d2, label)) AS label, min(d2) AS d2 FROM k WHERE d2 <= 16 GROUP BY r, c
""")
def grow_labels(v: Views):
    return raster.grow_labels(_labels(v), 4, v.side, v.side)


@query("shift_surface", """
SELECT dy, dx, cast(count(*) AS bigint) AS n, sum(b.v) AS total, round(sum(b.v) / count(*), 6) AS mean FROM range(-3, 4) y(dy), range(-3, 4) x(dx), dense a JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx WHERE a.inside AND b.support GROUP BY dy, dx
""")
def shift_surface(v: Views):
    return raster.shift_surface(v.dense(), 3)


_TWO = ", fa AS (SELECT r, c, sum(v) AS v FROM ma GROUP BY r, c), fb AS (SELECT r, c, sum(v) AS v FROM mb GROUP BY r, c)"


def _two(v: Views):
    total = lambda m: v.matrix(m).groupBy("r", "c").agg(F.sum("v").alias("v"))
    return total("A"), total("R")


@query("ncc_surface", _TWO + " SELECT dy, dx, cast(count(*) AS bigint) AS n, round(corr(a.v, b.v), 6) AS ncc FROM range(-2, 3) y(dy), range(-2, 3) x(dx), fa a JOIN fb b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY dy, dx")
def ncc_surface(v: Views):
    return raster.ncc_surface(*_two(v), 2)


@query("correlation_at_every_lag", _TWO + """
, h AS (SELECT s // 2 AS h FROM side), y AS (SELECT unnest(range(-h, h + 1)) AS dy FROM h), x AS (SELECT unnest(range(-h, h + 1)) AS dx FROM h),
k AS (SELECT dy, dx, cast(count(*) AS bigint) AS n, corr(a.v, b.v) AS k, var_pop(a.v) * var_pop(b.v) AS spread FROM fa a, y, x JOIN fb b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY dy, dx)
SELECT dy, dx, n, CASE WHEN n >= 3 AND spread > 0 THEN round(k, 6) END AS ncc FROM k
""")
def correlation_at_every_lag(v: Views):
    """Two matrices' totals at every lag up to half of the grid."""
    return transforms.correlation_surface(*_two(v), v.side, v.side, (v.side // 2, v.side // 2))


@query("mi_surface", _TWO + """
, ca AS (SELECT r, c, least(7, floor((v - min(v) OVER ()) * 8 / (max(v) OVER () - min(v) OVER ()))) AS x FROM fa), cb AS (SELECT r, c, least(7, floor((v - min(v) OVER ()) * 8 / (max(v) OVER () - min(v) OVER ()))) AS y FROM fb),
k AS (SELECT dy, dx, x, y, count(*) AS k FROM range(-1, 2) t1(dy), range(-1, 2) t2(dx), ca a JOIN cb b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY dy, dx, x, y),
p AS (SELECT *, sum(k) OVER (PARTITION BY dy, dx) AS n, sum(k) OVER (PARTITION BY dy, dx, x) AS kx, sum(k) OVER (PARTITION BY dy, dx, y) AS ky FROM k)
SELECT dy, dx, round(sum(k / n * ln(k * n / (kx * ky))), 6) AS mi FROM p GROUP BY dy, dx
""")
def mi_surface(v: Views):
    return raster.mi_surface(*_two(v), 1)


@query("eta2_surface", """
, o AS (SELECT dy, dx, dy * dy + dx * dx AS d2 FROM range(-6, 7) y(dy), range(-6, 7) x(dx) WHERE dy * dy + dx * dx <= 36),
n AS (SELECT a.r, a.c, a.inside, min(d2) FILTER (b.inside) AS di, min(d2) FILTER (NOT b.inside) AS dn FROM dense a, o JOIN dense b ON b.r = a.r + dy AND b.c = a.c + dx GROUP BY a.r, a.c, a.inside),
k AS (SELECT r, c, CASE WHEN inside THEN CASE WHEN dn <= 1 THEN 2 WHEN dn <= 4 THEN 1 ELSE 0 END WHEN di IS NULL THEN -1 ELSE 2 + ceil(sqrt(di)) END::int AS band FROM n),
m AS (SELECT y.dy, x.dx, band, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM range(-2, 3) y(dy), range(-2, 3) x(dx), k JOIN dense b ON b.r = k.r + y.dy AND b.c = k.c + x.dx WHERE b.support GROUP BY y.dy, x.dx, band)
SELECT dy, dx, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM m GROUP BY dy, dx
""")
def eta2_surface(v: Views):
    d = v.dense()
    return raster.eta2_surface(raster.distance_bands(d), d.where("support"), 2)


@query("local_maxima", """
, n AS (SELECT a.r, a.c, a.v, max(b.v) AS most, count(*) AS k FROM dense a JOIN dense b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.r, a.c, a.v)
SELECT r AS dy, c AS dx, v FROM n WHERE k = 8 AND v > most
""")
def local_maxima(v: Views):
    return raster.local_maxima(v.dense().select(F.col("r").alias("dy"), F.col("c").alias("dx"), "v"), "v", v.side)


_COEF = ((1.5, -2.5), (0.01, 0.05), (-0.03, 0.02))
_MOVED = ", mv AS (SELECT cast(r + round_even(1.5e0 + 1e-2 * r + -3e-2 * c, 0) AS bigint) AS nr, cast(c + round_even(-2.5e0 + 5e-2 * r + 2e-2 * c, 0) AS bigint) AS nc, cast(r * 100000 + c AS bigint) AS label, r, c FROM field), ap AS (SELECT nr AS r, nc AS c, arg_max(label, (r, c)) AS label, cast(count(*) AS bigint) AS met FROM mv WHERE nr BETWEEN 0 AND (SELECT s - 1 FROM side) AND nc BETWEEN 0 AND (SELECT s - 1 FROM side) GROUP BY nr, nc)"


def _moved(v: Views):
    return grid.apply_affine(v.field().select("r", "c", (F.col("r") * 100000 + F.col("c")).alias("label")), _COEF, v.side, v.side)


@query("apply_affine_collisions", _MOVED + " SELECT r, c, label, met FROM ap")
def apply_affine_collisions(v: Views):
    return _moved(v)


@query("remap_change_stats", _MOVED + """
, u AS (SELECT CASE WHEN f.r IS NULL THEN 'appears' WHEN ap.r IS NULL THEN 'disappears' WHEN f.r * 100000 + f.c = ap.label THEN 'stays' ELSE 'changes' END AS kind FROM field f FULL OUTER JOIN ap ON ap.r = f.r AND ap.c = f.c)
SELECT kind, cast(count(*) AS bigint) AS cells FROM u GROUP BY kind
""")
def remap_change_stats(v: Views):
    return grid.remap_statistics(v.field().select("r", "c", (F.col("r") * 100000 + F.col("c")).alias("label")), _moved(v))


_INVERSE = grid.inverse_affine(_COEF)
_PULLED = f"""
, sc AS (SELECT r, c, inside, cast((r // 6) * 1000 + c // 6 AS bigint) AS label FROM mask WHERE support),
pl AS (SELECT r, c, cast(round_even({_INVERSE[0][0]!r}::double * (r - 1.5e0) + {_INVERSE[0][1]!r}::double * (c + 2.5e0), 0) AS bigint) AS y, cast(round_even({_INVERSE[1][0]!r}::double * (r - 1.5e0) + {_INVERSE[1][1]!r}::double * (c + 2.5e0), 0) AS bigint) AS x FROM mask),
pu AS (SELECT pl.r, pl.c, y, x, inside, label FROM pl JOIN sc ON sc.r = y AND sc.c = x)"""


def _pulled(v: Views):
    cells = v.mask().where("support").select("r", "c", "inside", (F.floor(F.col("r") / 6) * 1000 + F.floor(F.col("c") / 6)).cast("long").alias("label"))
    return cells, grid.pull_affine(cells, _COEF, v.side, v.side)


@query("pulled_cells", _PULLED + """
, u AS (SELECT y, x, count(*) AS n FROM pu GROUP BY ALL)
SELECT label, cast(count(*) AS bigint) AS before, cast(coalesce(sum(n), 0) AS bigint) AS after, cast(count(*) FILTER (n IS NULL) AS bigint) AS dropped, cast(coalesce(sum(n - 1), 0) AS bigint) AS repeated FROM sc LEFT JOIN u ON y = sc.r AND x = sc.c GROUP BY label
""")
def pulled_cells(v: Views):
    """Labelled cells moved by an affine displacement, with an account of every label's places."""
    return grid.pull_account(*_pulled(v), "label")


@query("pulled_geometry", _PULLED + """
, pc AS (SELECT r // 8 AS pr, c // 8 AS pc, count(*) AS n FROM pu GROUP BY ALL)
SELECT cast(count(*) AS bigint) AS places, cast(count(*) FILTER (inside) AS bigint) AS inside, cast((SELECT count(*) FROM pl, side WHERE NOT (y BETWEEN 0 AND s - 1 AND x BETWEEN 0 AND s - 1)) AS bigint) AS without_source, cast((SELECT count(*) FROM pc WHERE n = 64) AS bigint) AS complete FROM pu
""")
def pulled_geometry(v: Views):
    cells, pulled = _pulled(v)
    every = grid.pull_affine(grid.dense_grid(v.spark, v.side, v.side), _COEF, v.side, v.side).agg((F.lit(v.side * v.side) - F.count(F.lit(1))).alias("without_source"))
    counts = pulled.agg(F.count(F.lit(1)).alias("places"), F.sum(F.col("inside").cast("long")).alias("inside"))
    return counts.crossJoin(every).crossJoin(grid.complete_parents(pulled, 8).agg(F.count(F.lit(1)).alias("complete")))  # one row each


@query("claimed_places", """
, cl AS (SELECT cast(r + round_even(-0.4e0 * r + 0.1e0 * c, 0) AS bigint) AS nr, cast(c + round_even(-0.3e0 * c, 0) AS bigint) AS nc, cast(r * 100000 + c AS bigint) AS label, v FROM field),
k AS (SELECT nr AS r, nc AS c, arg_min(label, (-v, label)) AS label, count(*) AS claims FROM cl WHERE nr BETWEEN 0 AND (SELECT s - 1 FROM side) AND nc BETWEEN 0 AND (SELECT s - 1 FROM side) GROUP BY 1, 2)
SELECT claims::bigint AS claims, cast(count(*) AS bigint) AS places, sum(label)::bigint AS digest FROM k GROUP BY 1
""")
def claimed_places(v: Views):
    """Cells pushed together; of those that claim one place, that with the most counts stays."""
    r, c = F.col("r"), F.col("c")
    to = [(r + F.rint(-0.4 * r + 0.1 * c)).cast("long").alias("nr"), (c + F.rint(-0.3 * c)).cast("long").alias("nc")]
    moved = v.field().select(*to, (r * 100000 + c).alias("label"), "v").where(F.col("nr").between(0, v.side - 1) & F.col("nc").between(0, v.side - 1))
    got = grid.claimed(moved.select(F.col("nr").alias("r"), F.col("nc").alias("c"), "label", "v"), [-F.col("v")])
    return got.groupBy("claims").agg(F.count(F.lit(1)).alias("places"), F.sum("label").alias("digest"))


@query("shift_clip", "SELECT r - 3 AS r, c + 5 AS c, v FROM field WHERE r - 3 BETWEEN 0 AND (SELECT s - 1 FROM side) AND c + 5 BETWEEN 0 AND (SELECT s - 1 FROM side)")
def shift_clip(v: Views):
    return grid.shift_cells(v.field(), -3, 5, v.side, v.side)


@query("grid_coordinates", "SELECT floor((1.5 * c + 10) / 8.0)::bigint AS x, floor((2.0 * r + 20) / 8.0)::bigint AS y, sum(v) AS v FROM field GROUP BY ALL")
def grid_coordinates(v: Views):
    at = lambda e: F.floor(e / 8.0)
    return v.field().groupBy(at(1.5 * F.col("c") + 10).alias("x"), at(2.0 * F.col("r") + 20).alias("y")).agg(F.sum("v").alias("v"))


@query("projected_roi", """
, p AS (SELECT (1.2 * c + 0.1 * r + 3) / (0.001 * c + 1) AS x, (-0.1 * c + 1.1 * r + 2) / (0.001 * c + 1) AS y, v FROM dense)
SELECT cast(count(*) AS bigint) AS cells, cast(count(*) FILTER (x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60) AS bigint) AS inside, round(sum(v) FILTER (x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60), 6) AS mass FROM p
""")
def projected_roi(v: Views):
    x, y = grid.project([[1.2, 0.1, 3], [-0.1, 1.1, 2], [0.001, 0, 1]], F.col("c"), F.col("r"))
    inside = x.between(0, 60) & y.between(0, 60)
    return v.dense().agg(F.count(F.lit(1)).alias("cells"), F.sum(inside.cast("long")).alias("inside"), F.round(F.sum(F.when(inside, F.col("v"))), 6).alias("mass"))


@query("affine_fit_moments", """
SELECT cast(count(*) AS bigint) AS n, round(regr_slope(v, r), 6) AS slope, round(regr_intercept(v, r), 6) AS intercept, round(corr(v, r), 6) AS pearson FROM dense
""")
def affine_fit_moments(v: Views):
    m = v.dense().agg(*S.moments(F.col("r").cast("double"), F.col("v")))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    slope = F.try_divide(n * F.col("sxy") - sx * sy, n * F.col("sxx") - sx * sx)
    return m.select("n", F.round(slope, 6).alias("slope"), F.round((sy - slope * sx) / n, 6).alias("intercept"), F.round(S.pearson_null(), 6).alias("pearson"))


@query("block_sums", """
, s AS (SELECT r // 16 AS br, c // 16 AS bc, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM dense WHERE support GROUP BY ALL)
SELECT br, bc, cast(n AS bigint) AS n, s, q, round(s / n, 6) AS mean FROM s
""")
def block_sums(v: Views):
    d = v.dense().where("support").groupBy(grid.parent(F.col("r"), 16).alias("br"), grid.parent(F.col("c"), 16).alias("bc"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).withColumn("mean", F.round(F.col("s") / F.col("n"), 6))

"""Queries on candidate reads, molecules and their policies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import grid, molecules
from ..operators.nearest import nearest
from ..operators.lineage import scratch
from ..sources.candidate_store import CandidateStore, group_calls
from .registry import query
from .views import Views


@query("ledger_group_check", """
, g AS (SELECT read_id, count(*) AS n, count(DISTINCT candidate) AS d, min(p) AS least, sum(p) AS total FROM post GROUP BY read_id)
SELECT n AS candidates, cast(count(*) AS bigint) AS reads, cast(count(*) FILTER (n <> d) AS bigint) AS duplicated, cast(count(*) FILTER (least < 0) AS bigint) AS negative, cast(count(*) FILTER (abs(total - 1) > 1e-9) AS bigint) AS unbalanced FROM g GROUP BY n
""")
def ledger_group_check(v: Views):
    g = v.posteriors().groupBy("read_id").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("candidate").alias("d"), F.min("p").alias("least"), F.sum("p").alias("total"))
    n = lambda x: F.sum(x.cast("long"))
    return g.groupBy("candidates").agg(F.count(F.lit(1)).alias("reads"), n(F.col("candidates") != F.col("d")).alias("duplicated"), n(F.col("least") < 0).alias("negative"), n(F.abs(F.col("total") - 1) > 1e-9).alias("unbalanced"))


@query("same_parent_flags", """
SELECT read_id, count(DISTINCT (r // 2, c // 2)) = 1 AS same_parent, count(DISTINCT candidate) = 1 AS same_cell FROM post GROUP BY read_id
""")
def same_parent_flags(v: Views):
    p = F.struct(grid.parent(F.col("r"), 2), grid.parent(F.col("c"), 2))
    return v.posteriors().groupBy("read_id").agg((F.min(p) == F.max(p)).alias("same_parent"), (F.min("candidate") == F.max("candidate")).alias("same_cell"))


@query("softmax_posterior", "SELECT read_id, candidate, round(p, 6) AS p FROM post")
def softmax_posterior(v: Views):
    return v.posteriors().select("read_id", "candidate", F.round("p", 6).alias("p"))


@query("hard_gate", """
, k AS (SELECT read_id, candidate, p, p - coalesce(lead(p) OVER w, 0) AS margin, row_number() OVER w AS k FROM (SELECT read_id, candidate, round(p, 9) AS p FROM post) WINDOW w AS (PARTITION BY read_id ORDER BY p DESC, candidate))
SELECT read_id, candidate, round(p, 6) AS p, round(margin, 6) AS margin, p >= 0.6 AND margin >= 0.3 AS assigned FROM k WHERE k = 1
""")
def hard_gate(v: Views):
    p = v.posteriors().withColumn("p", F.round("p", 9))
    return molecules.gated_calls(p, 0.6, 0.3).select(F.col("clique_key").alias("read_id"), "candidate", F.round("p", 6).alias("p"), F.round("margin", 6).alias("margin"), "assigned")


@query("soft_occupancy", "SELECT feature_id, umi, candidate, round(1 - product(1 - p), 6) AS expected, cast(count(*) AS bigint) AS cliques FROM post GROUP BY ALL")
def soft_occupancy(v: Views):
    return molecules.occupancies(v.posteriors()).withColumn("expected", F.round("expected", 6))


@query("strict_counts", """
, k AS (SELECT feature_id, read_id, min(candidate) AS unit FROM post GROUP BY feature_id, read_id HAVING count(DISTINCT candidate) = 1)
SELECT feature_id, unit, cast(count(*) AS bigint) AS molecules FROM k GROUP BY feature_id, unit
""")
def strict_counts(v: Views):
    return molecules.strict_counts(v.posteriors(), F.col("candidate"))


@query("mass_summary", """
, o AS (SELECT feature_id, umi, candidate, 1 - product(1 - p) AS e FROM post GROUP BY ALL)
SELECT cast((SELECT count(DISTINCT read_id) FROM post) AS bigint) AS reads, round((SELECT sum(p) FROM post), 4) AS read_mass, round(sum(e), 4) AS molecule_mass, cast(count(*) AS bigint) AS occupied FROM o
""")
def mass_summary(v: Views):
    p = v.posteriors()
    reads = p.agg(F.countDistinct("read_id").alias("reads"), F.round(F.sum("p"), 4).alias("read_mass"))
    return reads.crossJoin(molecules.occupancies(p).agg(F.round(F.sum("expected"), 4).alias("molecule_mass"), F.count(F.lit(1)).alias("occupied")))


@query("parent_collapse", "SELECT read_id, r // 2 AS r, c // 2 AS c, round(sum(p), 6) AS p FROM post GROUP BY ALL")
def parent_collapse(v: Views):
    return v.posteriors().groupBy("read_id", grid.parent(F.col("r"), 2).alias("r"), grid.parent(F.col("c"), 2).alias("c")).agg(F.round(F.sum("p"), 6).alias("p"))


@query("umi_collapse", """
, s AS (SELECT feature_id, candidate, umi, round(sum(p), 6) AS support FROM post GROUP BY ALL),
k AS (SELECT a.feature_id, a.candidate, a.umi, arg_min(b.umi, (-b.support, b.umi)) AS parent FROM s a JOIN s b ON a.feature_id = b.feature_id AND a.candidate = b.candidate AND hamming(a.umi, b.umi) = 1
  AND (b.support > a.support OR (b.support = a.support AND b.umi < a.umi)) AND b.support >= 2 * a.support - 1 GROUP BY ALL),
t AS (SELECT feature_id, candidate, umi, umi AS cur, 0 AS depth FROM s UNION ALL SELECT t.feature_id, t.candidate, t.umi, k.parent, depth + 1 FROM t JOIN k ON k.feature_id = t.feature_id AND k.candidate = t.candidate AND k.umi = t.cur)
SELECT feature_id, candidate, umi, arg_max(cur, depth) AS root FROM t GROUP BY ALL
""")
def umi_collapse(v: Views):
    s = v.posteriors().groupBy("feature_id", "candidate", "umi").agg(F.round(F.sum("p"), 6).alias("p"))
    return molecules.umi_collapse(s)


@query("read_cliques")
def read_cliques(v: Views):
    return molecules.read_cliques(v.candidates())


@query("clique_posteriors")
def clique_posteriors(v: Views):
    c = v.candidates()
    return molecules.posteriors(c, molecules.read_cliques(c)).select("feature_id", "umi", "clique_key", "candidate", F.round("p", 9).alias("p"))


@query("stored_group_calls", """
, w AS (SELECT cast(event_id AS varchar) AS read_id, event_type || '-' || (event_id % 40) AS feature_id, 'u' || (user_id % 4096) AS umi, 's_002um_' || ((event_id * 7 + k * 5) % (SELECT s FROM side)) || '_' || ((event_id * 11 + k * 3) % (SELECT s FROM side)) AS candidate,
  -((event_id * 13 + k * 7) % 10) / 4.0 AS ll FROM events, range(3) t(k) WHERE k <= event_id % 3),
p AS (SELECT *, exp(ll) / sum(exp(ll)) OVER (PARTITION BY read_id) AS p FROM w)
SELECT feature_id, umi, candidate, cast(count(*) AS bigint) AS reads, round(sum(p), 6) AS mass, round(1 - product(1 - p), 6) AS expected FROM p GROUP BY ALL
""")
def stored_group_calls(v: Views):
    """Groups of reads resolved from a bucketed store, whose groups and cells grow with the events."""
    store = CandidateStore(v.spark, scratch(v.spark, "store"), 16)
    store.write(v.wide_candidates())
    out = scratch(v.spark, "calls")
    store.resolve(group_calls, out)
    store.forget()
    return v.spark.read.parquet(f"{out}/data").select("feature_id", "umi", "candidate", "reads", F.round("mass", 6).alias("mass"), F.round("expected", 6).alias("expected"))


@query("wide_read_cliques")
def wide_read_cliques(v: Views):
    """Cliques of groups that grow in number with the events; the greedy order has no SQL form."""
    return molecules.read_cliques(v.wide_candidates())


@query("exact_member_match", """
, a AS (SELECT molecule, string_agg(read::varchar, ',' ORDER BY read::varchar) AS k FROM mol_a GROUP BY molecule), b AS (SELECT molecule, string_agg(read::varchar, ',' ORDER BY read::varchar) AS k FROM mol_b GROUP BY molecule)
SELECT a.molecule AS a, b.molecule AS b FROM a JOIN b USING (k)
""")
def exact_member_match(v: Views):
    return molecules.exact_member_matches(v.molecules("a"), v.molecules("b"))


_MEMBERS = """
, g AS (SELECT o_custkey AS label, count(DISTINCT a.molecule) AS na, count(DISTINCT b.molecule) AS nb, count(DISTINCT a.read) AS n FROM orders JOIN mol_a a ON a.read = o_orderkey JOIN mol_b b ON b.read = o_orderkey GROUP BY o_custkey)
"""


@query("membership_components", _MEMBERS + """
SELECT cast(na AS bigint) AS na, cast(nb AS bigint) AS nb, CASE WHEN nb = 1 THEN 'exact' ELSE 'split' END AS kind, cast(count(*) AS bigint) AS found, sum(n)::bigint AS shared FROM g GROUP BY ALL
""")
def membership_components(v: Views):
    got = molecules.membership_components(v.molecules("a"), v.molecules("b"))
    return got.groupBy("na", "nb", "kind").agg(F.count(F.lit(1)).alias("found"), F.sum("shared").alias("shared"))


@query("residual_components", _MEMBERS + """
SELECT cast(nb AS bigint) AS nb, 'split' AS kind, cast(count(*) AS bigint) AS found, sum(n)::bigint AS shared FROM g WHERE nb > 1 GROUP BY ALL
""")
def residual_components(v: Views):
    got = molecules.residual_components(v.molecules("a"), v.molecules("b"))
    return got.groupBy("nb", "kind").agg(F.count(F.lit(1)).alias("found"), F.sum("shared").alias("shared"))


@query("components")
def components(v: Views):
    """Parts and orders that items connect, all of them; SQL would reach every node from every other."""
    e = v.table("lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_partkey") - 1).alias("b")).distinct()
    return molecules.components(e)


@query("policy_eval", """
, q AS (SELECT read_id, feature_id, (cast(read_id AS bigint) * 3) % 4 AS vr, (cast(read_id AS bigint) * 5) % 4 AS vc, r, c, round(p, 9) AS p FROM post),
f AS (SELECT unnest([1, 4, 8]) AS factor), s AS (SELECT factor, read_id, r // factor = vr // factor AND c // factor = vc // factor AS same, p, r, c FROM q, f),
k AS (SELECT factor, read_id, sum(p) FILTER (same) AS soft, arg_max(same, (p, -r, -c)) AS hard FROM s GROUP BY ALL)
SELECT factor, cast(count(*) AS bigint) AS reads, cast(count(*) FILTER (hard) AS bigint) AS hard, round(sum(coalesce(soft, 0)), 6) AS soft FROM k GROUP BY factor
""")
def policy_eval(v: Views):
    p = v.posteriors().withColumn("p", F.round("p", 9))
    i = F.col("read_id").cast("long")
    vendor = p.select("read_id").distinct().select("read_id", (i * 3 % 4).alias("r"), (i * 5 % 4).alias("c"))
    return molecules.evaluate_policies(vendor, p.select("read_id", "r", "c", "p"))


@query("universe_partition", """
, u AS (SELECT event_id, event_id % 3 = 0 AS a, user_id % 4 = 0 AS b, event_type FROM events)
SELECT CASE WHEN a AND b THEN 'shared' WHEN a THEN 'a_only' WHEN b THEN 'b_only' ELSE 'neither' END AS part, event_type, cast(count(*) AS bigint) AS reads FROM u GROUP BY ALL
""")
def universe_partition(v: Views):
    e = v.table("events")
    a, b = e.where("event_id % 3 = 0").select("event_id", F.lit(True).alias("a")), e.where("user_id % 4 = 0").select("event_id", F.lit(True).alias("b"))
    met = e.join(a, "event_id", "left").join(b, "event_id", "left")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    part = F.when(x & y, "shared").when(x, "a_only").when(y, "b_only").otherwise("neither")
    return met.groupBy(part.alias("part"), "event_type").agg(F.count(F.lit(1)).alias("reads"))


@query("priority_merge", """
, l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'deny' WHEN event_id % 2 = 0 THEN 'keep' ELSE 'miss' END AS action, 'h' || (user_id % 7) AS hashed, CASE WHEN user_id % 3 > 0 THEN 'al' || (user_id % 7) END AS aligned FROM events)
SELECT CASE action WHEN 'keep' THEN hashed WHEN 'miss' THEN aligned END AS feature, CASE WHEN action = 'keep' THEN 'hash' WHEN action = 'miss' AND aligned IS NOT NULL THEN 'alignment' ELSE 'none' END AS source, cast(count(*) AS bigint) AS reads FROM l GROUP BY ALL
""")
def priority_merge(v: Views):
    e = v.table("events").select("event_id", "user_id")
    action = F.when(F.col("event_id") % 5 == 0, "deny").when(F.col("event_id") % 2 == 0, "keep").otherwise("miss")
    ledger = e.select("event_id", action.alias("action"))
    hashes = e.select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("hashed"))
    aligned = e.where("user_id % 3 > 0").select("event_id", F.concat(F.lit("al"), (F.col("user_id") % 7).cast("string")).alias("aligned"))
    met = ledger.join(hashes, "event_id", "left").join(aligned, "event_id", "left")
    feature = F.when(F.col("action") == "keep", F.col("hashed")).when(F.col("action") == "miss", F.col("aligned"))
    source = F.when(F.col("action") == "keep", "hash").when((F.col("action") == "miss") & F.col("aligned").isNotNull(), "alignment").otherwise("none")
    return met.groupBy(feature.alias("feature"), source.alias("source")).agg(F.count(F.lit(1)).alias("reads"))


@query("h0_prior", """
, u AS (SELECT read_id, min(r) AS r, min(c) AS c FROM cand GROUP BY read_id HAVING count(*) = 1), h AS (SELECT 'BC1' AS half, c AS idx FROM u UNION ALL SELECT 'BC2', r FROM u)
SELECT half, i AS idx, cast(count(h.idx) AS bigint) AS reads, round(ln(count(h.idx) + 1), 6) AS log_prior FROM (SELECT unnest(['BC1', 'BC2']) AS half) a CROSS JOIN range(6) t(i) LEFT JOIN h ON h.half = a.half AND h.idx = i GROUP BY ALL
""".replace("SELECT half, i AS idx", "SELECT a.half AS half, i AS idx"))
def h0_prior(v: Views):
    """Counts of reads with one candidate by half index, those never seen included."""
    u = v.candidates().groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"), F.min("c").alias("c")).where("n = 1")
    halves = u.select(F.explode(F.array(F.struct(F.lit("BC1").alias("half"), F.col("c").alias("idx")), F.struct(F.lit("BC2").alias("half"), F.col("r").alias("idx")))).alias("h")).groupBy("h.half", "h.idx").agg(F.count(F.lit(1)).alias("reads"))
    axis = v.spark.range(12).select(F.when(F.col("id") < 6, "BC1").otherwise("BC2").alias("half"), (F.col("id") % 6).alias("idx"))
    return axis.join(halves, ["half", "idx"], "left").select("half", "idx", F.coalesce("reads", F.lit(0)).alias("reads"), F.round(F.ln(F.coalesce("reads", F.lit(0)) + 1), 6).alias("log_prior"))


@query("molecule_mates", """
, m AS (SELECT l_orderkey AS mol, cast(count(*) AS bigint) AS reads, cast(count(*) FILTER (l_returnflag = 'N') AS bigint) AS unassigned FROM lineitem GROUP BY l_orderkey)
SELECT reads, unassigned, cast(count(*) AS bigint) AS molecules, unassigned > 0 AND unassigned < reads AS has_mates FROM m GROUP BY ALL
""")
def molecule_mates(v: Views):
    m = v.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("reads"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("unassigned"))
    return m.groupBy("reads", "unassigned", ((F.col("unassigned") > 0) & (F.col("unassigned") < F.col("reads"))).alias("has_mates")).agg(F.count(F.lit(1)).alias("molecules"))


_OLIGO = ", o AS (SELECT p_partkey, md5(p_name || p_brand) AS h FROM part), p AS (SELECT p_partkey, substr(h, 1, 15) AS s FROM o), q AS (SELECT p_partkey, substr(h, 1, 3) || 'x' || substr(h, 5, 7) || CASE WHEN p_partkey % 3 = 0 THEN 'y' ELSE substr(h, 12, 1) END || substr(h, 13, 3) AS s FROM o)"


def _oligos(v: Views):
    h = F.md5(F.concat("p_name", "p_brand"))
    p = v.table("part")
    part = lambda at, n: F.substring(h, at, n)
    last = F.when(F.col("p_partkey") % 3 == 0, "y").otherwise(part(12, 1))
    return p.select("p_partkey", part(1, 15).alias("s")), p.select("p_partkey", F.concat(part(1, 3), F.lit("x"), part(5, 7), last, part(13, 3)).alias("s"))


@query("hamming_seed_join", _OLIGO + ", k AS (SELECT q.p_partkey AS q, p.p_partkey AS p, hamming(q.s, p.s) AS d FROM q JOIN p ON hamming(q.s, p.s) <= 2) SELECT q, p, cast(d AS int) AS d FROM (SELECT *, min(d) OVER (PARTITION BY q) AS least FROM k) WHERE d = least")
def hamming_seed_join(v: Views):
    """Nearest probes at Hamming distance 2 at most: of three segments of five one is equal, so segments meet in an equi-join."""
    p, q = _oligos(v)
    return molecules.nearest_probes(q.withColumnRenamed("p_partkey", "q"), p.withColumnRenamed("p_partkey", "p"), 5, 3)


@query("best_split", """
, s AS (SELECT s_suppkey, s_name, k, levenshtein(substr(s_name, 1, k), 'Supplier') AS e1, levenshtein(substr(s_name, k + 1), '000000042') AS e2 FROM supplier, range(5, 13) t(k))
SELECT s_suppkey, arg_min(k, (e1 + e2, greatest(e1, e2), e1, k))::bigint AS split, arg_min(e1, (e1 + e2, greatest(e1, e2), e1, k))::int AS e1, arg_min(e2, (e1 + e2, greatest(e1, e2), e1, k))::int AS e2 FROM s GROUP BY s_suppkey
""")
def best_split(v: Views):
    s = v.table("supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(5), F.lit(12))).alias("k"))
    e1 = F.levenshtein(F.substr(F.col("s_name"), F.lit(1), F.col("k")), F.lit("Supplier"))
    e2 = F.levenshtein(F.substr(F.col("s_name"), F.col("k") + 1), F.lit("000000042"))
    best = F.min(F.struct((F.col("e1") + F.col("e2")).alias("t"), F.greatest("e1", "e2").alias("g"), "e1", "k", "e2")).alias("b")
    return s.withColumn("e1", e1).withColumn("e2", e2).groupBy("s_suppkey").agg(best).select("s_suppkey", F.col("b.k").cast("long").alias("split"), "b.e1", "b.e2")


_KNN = ", q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS q, x.vec_id AS x, round(list_distance(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 5) AS d FROM q, embeddings x WHERE x.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, x) AS k FROM d)"


def _knn(v: Views, k: int):
    """The k nearest rows of every row whose id is divisible by 50."""
    e = v.table("embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("vector"))
    return nearest(e, e.where("x % 50 = 0").withColumnRenamed("x", "q"), k)


@query("knn_ratio", _KNN + " SELECT q, max(x) FILTER (k = 1) AS x, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2, round(max(d) FILTER (k = 1) / max(d) FILTER (k = 2), 4) AS ratio FROM k WHERE k <= 2 GROUP BY q")
def knn_ratio(v: Views):
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return _knn(v, 2).groupBy("q").agg(at("x", 1).alias("x"), at("d", 1).alias("d1"), at("d", 2).alias("d2")).withColumn("ratio", F.round(F.try_divide("d1", "d2"), 4))


@query("mutual_knn", _KNN + ", n AS (SELECT q, x FROM k WHERE k <= 10) SELECT a.q AS a, a.x AS b FROM n a JOIN n b ON a.q = b.x AND a.x = b.q WHERE a.q < a.x")
def mutual_knn(v: Views):
    n = _knn(v, 10).select("q", "x")
    return n.join(n.select(F.col("x").alias("q"), F.col("q").alias("x")), ["q", "x"]).where("q < x").select(F.col("q").alias("a"), F.col("x").alias("b"))


@query("stable_ids", "SELECT event_type, user_id, substr(sha256('rc' || chr(31) || event_type || chr(31) || user_id::varchar), 1, 24) AS id, cast(count(*) AS bigint) AS n FROM events GROUP BY ALL")
def stable_ids(v: Views):
    return v.table("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).select("event_type", "user_id", S.stable_id(F.lit("rc"), F.col("event_type"), F.col("user_id").cast("string")).alias("id"), "n")

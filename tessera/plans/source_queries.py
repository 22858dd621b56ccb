"""Queries whose tables are first written as the files of a format and read back from them."""

from pyspark.sql import functions as F

from ..operators import grid
from ..operators.lineage import scratch
from ..sources import matrix, tables
from .registry import query
from .views import Views


def _text(v: Views, df, what: str, schema: str):
    """``df`` after a way through compressed text."""
    path = scratch(v.spark, what)
    tables.write_tsv(df, path)
    return tables.read_tsv(v.spark, path, schema)


@query("matrix_directory", " SELECT 'f' || feature_id AS feature_id, r, c, v FROM ma")
def matrix_directory(v: Views):
    """A matrix written as a compressed Matrix Market directory and read back."""
    path = scratch(v.spark, "mex")
    matrix.write_mex(v.matrix("A").withColumn("feature_id", F.concat(F.lit("f"), F.col("feature_id").cast("string"))), path)
    return matrix.read_mex(v.spark, path)


@query("matrix_axis_totals", " SELECT 'feature' AS axis, 'f' || feature_id AS feature_id, NULL::bigint AS r, NULL::bigint AS c, sum(v) AS v FROM mb GROUP BY ALL UNION ALL SELECT 'bin', NULL, r, c, sum(v) FROM mb GROUP BY ALL")
def matrix_axis_totals(v: Views):
    path = scratch(v.spark, "mex")
    matrix.write_mex(v.matrix("R").withColumn("feature_id", F.concat(F.lit("f"), F.col("feature_id").cast("string"))), path)
    return matrix.axis_totals(matrix.read_mex(v.spark, path))


_MOLECULES = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'corrected' END AS umi_mode, o_orderstatus AS product, o_orderpriority AS feature_id, substr(md5(o_orderkey::varchar), 1, 6) AS umi, 's_002um_' || (o_custkey % 64) || '_' || (o_orderkey % 64) AS unit, o_orderkey FROM orders"


def _molecules(v: Views):
    k = F.col("o_orderkey")
    ids = F.concat(F.lit("a"), k.cast("string"), F.lit(";b"), k.cast("string"))
    d = v.table("orders").select(F.when(k % 2 == 0, "raw").otherwise("corrected").alias("umi_mode"), F.col("o_orderstatus").alias("product"), F.col("o_orderpriority").alias("feature_id"), F.substring(F.md5(k.cast("string")), 1, 6).alias("umi"), grid.bin_id(2, F.col("o_custkey") % 64, k % 64).alias("unit"), ids.alias("member_read_ids"))
    return _text(v, d, "molecules", tables.SCHEMAS["molecules"])


@query("open_reads", f"SELECT feature_id, cast(2 * count(*) AS bigint) AS reads, cast(count(DISTINCT umi || unit) AS bigint) AS molecules FROM ({_MOLECULES}) WHERE umi_mode = 'raw' AND product = 'O' GROUP BY 1", prelude=False)
def open_reads(v: Views):
    got = tables.open_reads(_molecules(v), "raw", "O")
    return got.groupBy("feature_id").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct(F.concat("umi", "unit")).alias("molecules"))


@query("product_reads", f"SELECT product, cast(2 * count(*) AS bigint) AS reads, cast(count(DISTINCT unit) AS bigint) AS units FROM ({_MOLECULES}) WHERE umi_mode = 'corrected' GROUP BY 1", prelude=False)
def product_reads(v: Views):
    return tables.product_reads(_molecules(v), "corrected").groupBy("product").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("unit").alias("units"))


@query("product_fields", f"SELECT product, umi_mode, split_part(unit, '_', 3)::bigint AS r, split_part(unit, '_', 4)::bigint AS c, cast(count(*) AS bigint) AS v FROM ({_MOLECULES}) GROUP BY ALL", prelude=False)
def product_fields(v: Views):
    return tables.product_fields(_molecules(v))


@query("clique_table", """
, k AS (SELECT read_id, r, c, round(p, 12) AS p FROM post), o AS (SELECT read_id, count(*) AS n, arg_max((r, c), (p, -r, -c)) AS b, max(p) AS p FROM k GROUP BY read_id)
SELECT cast(n AS bigint) AS candidates, b[1] AS r, b[2] AS c, cast(count(*) AS bigint) AS cliques, round(sum(p), 6) AS best FROM o GROUP BY ALL
""")
def clique_table(v: Views):
    p = v.posteriors()
    d = p.select(F.concat(F.lit("k"), "read_id").alias("clique_id"), "feature_id", "umi", "r", "c", F.round("p", 12).alias("posterior"), F.col("read_id").alias("member_read_ids"))
    got = tables.cliques(_text(v, d, "cliques", tables.SCHEMAS["cliques"]))
    first = F.col("candidates")[0]
    return got.groupBy(F.size("candidates").cast("long").alias("candidates"), first["r"].alias("r"), first["c"].alias("c")).agg(F.count(F.lit(1)).alias("cliques"), F.round(F.sum(first["p"]), 6).alias("best"))


@query("candidate_table", ", k AS (SELECT read_id, count(*) AS n, sum(r * 4 + c) AS d FROM cand GROUP BY read_id) SELECT cast(n AS bigint) AS candidates, cast(count(*) AS bigint) AS reads, sum(d)::bigint AS digest FROM k GROUP BY n")
def candidate_table(v: Views):
    d = v.candidates().select("read_id", (F.col("read_id").cast("long") % 3 + 1).cast("int").alias("candidate_count"), "r", "c", F.lit(0).alias("e1"), F.lit(1).alias("e2"))
    got = tables.raw_candidates(_text(v, d, "candidates", tables.SCHEMAS["candidates"]))
    digest = F.aggregate("candidates", F.lit(0).cast("long"), lambda s, x: s + x["r"] * 4 + x["c"])
    return got.groupBy(F.size("candidates").cast("long").alias("candidates")).agg(F.count(F.lit(1)).alias("reads"), F.sum(digest).alias("digest"))


@query("vendor_molecules", "SELECT event_type AS feature_id, cast(count(*) AS bigint) AS molecules, sum(n)::bigint AS reads FROM (SELECT event_type, user_id % 97 AS u, user_id % 5 AS w, count(*) AS n FROM events WHERE event_id % 4 > 0 AND user_id % 5 < 4 GROUP BY ALL) GROUP BY 1", prelude=False)
def vendor_molecules(v: Views):
    e = v.table("events")
    unit = F.when(F.col("user_id") % 5 < 4, (F.col("user_id") % 5).cast("string"))
    d = e.select(F.col("event_id").cast("string").alias("read_id"), F.col("event_type").alias("feature_id"), (F.col("user_id") % 97).cast("string").alias("umi"), unit.alias("unit"), (F.col("event_id") % 4 > 0).alias("eligible"))
    got = tables.vendor_molecules(_text(v, d, "reads", tables.SCHEMAS["reads"]))
    return got.groupBy("feature_id").agg(F.count(F.lit(1)).alias("molecules"), F.sum("reads").alias("reads"))


@query("hash_ledger", "SELECT 'g' || (user_id % 11) AS feature_id, cast(count(*) AS bigint) AS reads FROM events WHERE event_id % 3 = 0 GROUP BY 1", prelude=False)
def hash_ledger(v: Views):
    keep = F.col("event_id") % 3 == 0
    d = v.table("events").select(F.col("event_id").cast("string").alias("read_id"), F.when(keep, "keep").otherwise("deny").alias("action"), F.when(keep, F.concat(F.lit("g"), (F.col("user_id") % 11).cast("string"))).alias("feature_id"))
    return tables.hash_reads(_text(v, d, "hashes", tables.SCHEMAS["hashes"])).groupBy("feature_id").agg(F.count(F.lit(1)).alias("reads"))


@query("field_in_region", " SELECT field.r, field.c, v FROM field JOIN mask ON mask.r = field.r AND mask.c = field.c WHERE inside AND v > 0")
def field_in_region(v: Views):
    d = v.field().where("v > 0").select(grid.bin_id(2, F.col("r"), F.col("c")).alias("unit_2um"), F.col("v").alias("molecule_mass"))
    return tables.roi_field(_text(v, d, "field", tables.SCHEMAS["field"]), v.mask().where("inside"))


@query("compartment_states", " SELECT CASE WHEN inside THEN 2 WHEN support THEN 1 ELSE 0 END AS state, cast(count(*) AS bigint) AS cells FROM mask JOIN field ON mask.r = field.r AND mask.c = field.c GROUP BY 1")
def compartment_states(v: Views):
    d = v.mask().join(v.field().select("r", "c"), ["r", "c"], "left_semi").select("r", "c", F.col("inside").alias("in_nucleus"), (F.col("support") | F.col("inside")).alias("in_cell"))
    return tables.compartments(_text(v, d, "compartments", tables.SCHEMAS["compartments"])).groupBy("state").agg(F.count(F.lit(1)).alias("cells"))


@query("tissue_positions", " SELECT r // 8 AS br, cast(count(*) AS bigint) AS cells, cast(count(*) FILTER (support) AS bigint) AS tissue FROM mask GROUP BY 1")
def tissue_positions(v: Views):
    d = v.mask().select("r", "c", F.col("support").cast("int").alias("in_tissue"))
    got = tables.tissue_mask(_text(v, d, "positions", "r long, c long, in_tissue int"), v.side)
    return got.groupBy(F.floor(F.col("r") / 8).alias("br")).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("tissue").cast("long")).alias("tissue"))


@query("factored_prior", """
, n AS (SELECT c AS idx, count(*) AS n FROM post GROUP BY c), m AS (SELECT r AS idx, count(*) AS n FROM post GROUP BY r)
SELECT r, c, round(ln(n.n + 1) + ln(m.n + 1), 6) AS log_prior FROM (SELECT DISTINCT r, c FROM post) p JOIN n ON n.idx = p.c JOIN m ON m.idx = p.r
""")
def factored_prior(v: Views):
    p = v.posteriors()
    half = lambda name, key: p.groupBy(F.col(key).alias("idx")).agg(F.count(F.lit(1)).alias("reads")).select(F.lit(name).alias("half"), "idx", F.lit("A").alias("sequence"), "reads")
    prior = tables.half_prior(_text(v, half("BC1", "c").unionByName(half("BC2", "r")), "prior", tables.SCHEMAS["prior"]))
    return tables.factored_prior(p.select("r", "c").distinct(), prior).select("r", "c", F.round("log_prior", 6).alias("log_prior"))


@query("fastq_records", "SELECT length(p_name) AS size, cast(count(*) AS bigint) AS records, min(p_partkey)::bigint AS first FROM part WHERE p_partkey % 2 = 1 GROUP BY 1", prelude=False)
def fastq_records(v: Views):
    """Records of a set of reads from compressed FASTQ files."""
    path = scratch(v.spark, "fastq")
    p = v.table("part")
    p.select(F.concat(F.lit("@p"), F.col("p_partkey").cast("string"), F.lit(" x\n"), F.col("p_name"), F.lit("\n+\n"), F.rpad(F.lit("@"), F.length("p_name"), F.lit("I")))).write.option("compression", "gzip").text(path)
    wanted = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("read_id"))
    # names compress too well for their size on disk to tell whether they can be broadcast
    got = tables.read_fastq(v.spark, path).hint("merge").join(wanted, "read_id", "left_semi")
    return got.groupBy(F.length("sequence").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("records"), F.min(F.substring("read_id", 2, 20).cast("long")).alias("first"))


@query("sharded_table", "SELECT o_orderpriority AS priority, cast(count(*) AS bigint) AS rows, 1::bigint AS shards FROM orders GROUP BY 1", prelude=False)
def sharded_table(v: Views):
    """Equal keys are in one shard, and nothing is lost on the way."""
    path = scratch(v.spark, "shards")
    tables.write_shards(v.table("orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey"), path, "priority", 4)
    back = v.spark.read.schema("priority string, o_orderkey long, shard int").option("sep", "\t").option("header", True).csv(path)
    return back.groupBy("priority").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("shard").alias("shards"))

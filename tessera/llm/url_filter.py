"""URL verdicts by host rules and a path-template tree, with DataFrame functions alone.

Rules decide first; the longest that fits wins. The rest is judged by a tree of path templates. Urls that a rule decided
are its labelled examples. A path becomes a list of segments; numbers, hexadecimal and mixed segments become wildcards
by their form, and a segment whose parent has many children with few urls each becomes one by count, level by level from the
root to the deepest segment of the data, but for levels where no host has enough children. Siblings at any level whose labelled block rate, all below them included, does not
differ from that of the others by a two-proportion test merge into one branch, from the deepest level up. A template's
purity, its share of blocked examples, is smoothed towards that of the same template over all hosts, and that towards
the rate of all; templates with purity of a half or more are rejected.

Everything after the first step works on counts per host and template, so a host with a third of all urls is summed
before it meets anything.

Defined cases: a null url, or one without ://, has an empty host and path and is judged as the template of the empty
path; repeated rows are judged alike; without any labelled url everything is allowed; an empty table gives no rows. Only
page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import finished, keep, table

#: Fixed rules: host, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A parent with more children than this, holding fewer urls each than the second number, has a wildcard child.
MANY_CHILDREN, FEW_URLS = 20, 4.0
#: Pseudo-counts of the smoothing and the critical value of the merge test.
PRIOR, CRITICAL = 4.0, 1.96

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def form(path: Column) -> Column:
    """The path with every segment generalised by its form."""

    def one(s: Column) -> Column:
        tail = F.regexp_extract(s, r"(\.[a-z]{2,5})$", 1)
        stem = F.regexp_replace(s, r"\.[a-z]{2,5}$", "")
        kind = F.when(stem.rlike("^[0-9]+$"), F.lit("{n}")).when((F.length(stem) >= 8) & stem.rlike("^[0-9a-f-]+$"), F.lit("{x}")).when(stem.rlike("[0-9]"), F.lit("{m}")).otherwise(stem)
        return F.concat(kind, tail)

    return F.transform(F.split(path, "/"), one)


def _wildcards(tree: DataFrame, depth: int) -> DataFrame:
    """Makes the segment at ``depth`` (from 1) a wildcard where its parent has many children with few urls each."""
    parent = F.slice("now", 1, depth)
    child = F.get(F.col("now"), F.lit(depth))
    stat = tree.where(F.size("now") > depth).groupBy("host", parent.alias("parent")).agg(F.count_distinct(child).alias("children"), F.sum("n").alias("urls"))
    stat = stat.where((F.col("children") > MANY_CHILDREN) & (F.col("urls") < FEW_URLS * F.col("children"))).select(F.col("host").alias("_h"), F.col("parent").alias("_p"), F.lit(True).alias("_many"))
    joined = tree.join(stat, (tree["host"] == F.col("_h")) & (parent == F.col("_p")) & (F.size("now") > depth), "left")
    changed = F.transform("now", lambda x, i: F.when(i == depth, F.lit("*")).otherwise(x))
    return joined.withColumn("now", F.when(F.col("_many"), changed).otherwise(F.col("now"))).drop("_h", "_p", "_many")


def _merge(tree: DataFrame, depth: int) -> DataFrame:
    """The segment at ``depth`` becomes a wildcard where the labelled rate of its branch, all below it included, is not
    unlike that of all its siblings."""
    branch = tree.where(F.size("now") > depth).groupBy("host", F.slice("now", 1, depth + 1).alias("node")).agg(F.sum("m").alias("bm"), F.sum("b").alias("bb"))
    branch = branch.withColumn("parent", F.slice("node", 1, depth))
    up = branch.groupBy(F.col("host").alias("_h"), F.col("parent").alias("_p")).agg(F.sum("bm").alias("pm"), F.sum("bb").alias("pb"), F.count(F.lit(1)).alias("k"))
    both = branch.join(up, (F.col("host") == F.col("_h")) & (F.col("parent") == F.col("_p")))
    om, ob = F.col("pm") - F.col("bm"), F.col("pb") - F.col("bb")
    rate = F.try_divide(F.col("pb"), F.col("pm"))
    gap = F.abs(F.try_divide(F.col("bb"), F.col("bm")) - F.try_divide(ob, om))
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) * (F.try_divide(F.lit(1.0), F.col("bm")) + F.try_divide(F.lit(1.0), om)))
    alike = both.where((F.col("k") > 1) & F.coalesce(gap <= CRITICAL * error, F.lit(False))).select(F.col("host").alias("_h"), F.col("node").alias("_n"), F.lit(True).alias("_alike"))
    joined = tree.join(alike, (tree["host"] == F.col("_h")) & (F.slice("now", 1, depth + 1) == F.col("_n")) & (F.size("now") > depth), "left")
    changed = F.transform("now", lambda x, i: F.when(i == depth, F.lit("*")).otherwise(x))
    return joined.withColumn("now", F.when(F.col("_alike"), changed).otherwise(F.col("now"))).drop("_h", "_n", "_alike")


def _depths(tree: DataFrame, more_than: int, rows: Column) -> list[int]:
    """Depths at which some host has more than so many distinct segments among ``rows``, whatever stands before them: no parent of
    a depth left out has so many children. One pass; a host with few long urls adds no depth."""
    segments = tree.where(rows).select("host", F.posexplode("now").alias("depth", "segment")).where("depth > 0").distinct()
    wide = segments.groupBy("host", "depth").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > more_than)
    return sorted(r.depth for r in wide.select("depth").distinct().collect())  # at most the segments of one url


def template_tree(judged: DataFrame) -> DataFrame:
    """host, form, template and purity of every host and form among the judged urls."""
    labelled = F.col("ruled").isNotNull().cast("long")
    tree = judged.groupBy("host", "form").agg(F.count(F.lit(1)).alias("n"), F.sum(labelled).alias("m"), F.sum((F.col("ruled") == "block").cast("long")).alias("b"))
    tree = keep(tree.select("host", "form", F.col("form").alias("now"), "n", "m", F.coalesce("b", F.lit(0)).alias("b")), "tree")
    for depth in _depths(tree, MANY_CHILDREN, F.lit(True)):
        tree = keep(_wildcards(tree, depth), "tree")
    for depth in reversed(_depths(tree, 1, F.col("m") > 0)):  # branches are told apart by their labelled urls
        tree = keep(_merge(tree, depth), "tree")
    rate = tree.agg(((F.sum("b") + 1) / (F.sum("m") + 2)).alias("p0")).first()["p0"]
    smooth = lambda m, b, p: (F.col(b) + PRIOR * p) / (F.col(m) + PRIOR)
    everywhere = tree.groupBy(F.col("now").alias("_now")).agg(F.sum("m").alias("tm"), F.sum("b").alias("tb")).withColumn("p1", smooth("tm", "tb", F.lit(rate if rate is not None else 0.0)))
    own = tree.groupBy(F.col("host").alias("_host"), F.col("now").alias("_own")).agg(F.sum("m").alias("hm"), F.sum("b").alias("hb"))
    scored = own.join(everywhere, F.col("_own") == F.col("_now")).select("_host", "_own", smooth("hm", "hb", F.col("p1")).alias("purity"))
    named = tree.join(scored, (F.col("host") == F.col("_host")) & (F.col("now") == F.col("_own")))
    return named.select("host", "form", F.array_join("now", "/").alias("template"), "purity")


def judge_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url."""
    host, path = split_url()
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = apply_rules(F.col("host"), F.col("path"))
    judged = split.select("*", rule.alias("rule"), ruled.alias("ruled"), form(F.col("path")).alias("form"))
    tree = finished("templates", lambda: template_tree(judged)).withColumnsRenamed({"host": "_host", "form": "_form"})
    out = judged.join(tree, (F.col("host") == F.col("_host")) & (F.col("form") == F.col("_form")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))

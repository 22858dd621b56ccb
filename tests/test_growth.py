"""Steps whose memory, time or rows must not outgrow the input, against plain versions of them."""

import random

from pyspark.sql import functions as F

from tessera.operators import candidates, molecules


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_nearest_probes_of_copies_without_broadcast(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("ab") for _ in range(15))
    texts = [some() for _ in range(12)]
    p = [(k, rng.choice(texts)) for k in range(80)]
    q = [(k, "".join(c if rng.random() > 0.07 else "x" for c in rng.choice(texts))) for k in range(60)]
    away = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = []
    for k, a in q:
        least = min(away(a, b) for _, b in p)
        want += [(k, j, least) for j, b in p if least <= 2 and away(a, b) == least]
    got = molecules.nearest_probes(spark.createDataFrame(q, "q long, s string"), spark.createDataFrame(p, "p long, s string"), 5, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 80
    assert "Broadcast" not in _plan(got)[1]


def test_hits_are_measured_before_they_are_sent(spark):
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(7, 11)))
    halves, texts = [some() for _ in range(60)], [some() for _ in range(9)] + [""]
    names = [(k, rng.choice(texts)) for k in range(70)]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j - 1] + (p != q), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    a, b = spark.createDataFrame([(x,) for x in halves], "text string"), spark.createDataFrame(names, "name long, text string")
    for most in (1, 3, 4):
        got = candidates.half_hits(a, b, "name", "edits", most)
        want = sorted((x, k, distance(x, y)) for x in set(halves) for k, y in names if distance(x, y) <= most)
        assert sorted(map(tuple, got.collect())) == want
        plan = _plan(got)[0]
        assert plan.index("Aggregate") < plan.index("levenshtein")  # the topmost sets of rows are of hits


def test_hits_of_many_names_of_one_text(spark, tmp_path):
    halves = ["ACGTACGTA", "ACGTACGT", "CCGTACGTA", "ACGTACGTACG", "TTTTTTTTT"] + ["ACGTACG" + x + y for x in "ACG" for y in "CGT"]
    a = spark.createDataFrame([(x,) for x in halves * 2], "text string")
    # repeated rows, a name without index and names that fill blocks and do not
    n = candidates.NAMES_IN_BLOCK
    names = [(k, "ACGTACGTA") for k in [*range(2 * n + 3), 5, 5, None]] + [(k, "AACCGGTTA") for k in range(n)] + [(7, None), (8, "ACG")]
    got = candidates.half_hits(a, spark.createDataFrame(names, "name long, text string"), "name", "edits", 3)
    edits = {(r.x, r.y): r.d for r in spark.createDataFrame([(x, y) for x in halves for _, y in names[-n - 3 :] + names[:1]], "x string, y string").select("x", "y", F.levenshtein("x", "y").alias("d")).collect()}
    want = [(x, k, edits[x, y]) for x in halves for k, y in names if y and edits[x, y] <= 3]
    order = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order) and len(want) > 10 * n
    # more names than a file's dictionary holds: a hit takes less than a byte
    many = spark.range(400_000).select(F.col("id").alias("name"), F.when(F.col("id") % 2 == 0, "ACGTACGTA").otherwise("AACCGGTTA").alias("text"))
    candidates.half_hits(a, many, "name", "edits", 3).write.parquet(f"{tmp_path}/hits")
    rows, stored = spark.read.parquet(f"{tmp_path}/hits").count(), sum(f.stat().st_size for f in (tmp_path / "hits").glob("*.parquet"))
    assert rows >= 2_000_000 and stored < rows, (rows, stored)


def test_many_groups_share_a_batch_and_a_group_many_batches(spark):
    rng = random.Random(5)
    sets = {(g, f"r{k:02d}"): sorted(rng.sample("abcdefghijkl", rng.randint(1, 4))) for g in range(30) for k in range(rng.randint(1, 30))}
    rows = [(r, f"g{g}", "A", c, 0.0) for (g, r), own in sets.items() for c in own]
    want, held = [], {}
    for (g, r), own in sorted(sets.items()):
        best = min(((sorted(set(own) & x[0]), k) for k, x in enumerate(held.setdefault(g, [])) if set(own) & x[0]), default=None)
        if best:
            held[g][best[1]][0].intersection_update(own)
        else:
            held[g].append((set(own), r))
        want.append((r, f"g{g}", held[g][best[1] if best else -1]))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = molecules.read_cliques(spark.createDataFrame(rows, "read_id string, feature_id string, umi string, candidate string, ll double"))
        found = sorted((r.feature_id, r.read_id, r.clique_key, tuple(r.candidates)) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == sorted((g, r, x[1], tuple(sorted(x[0]))) for r, g, x in want)
    assert "FlatMapGroups" not in _plan(got)[0]


def test_probes_are_one_row_each_before_levels(spark, tmp_path):
    from tessera.plans import registry

    rng = random.Random(6)
    rows = [(rng.choice([1.0, 25.0, 40.0, None]), rng.choice([0.01, 0.05, None]), rng.choice([1, 2, 3, 4, None])) for _ in range(200)]
    spark.createDataFrame(rows, "l_quantity double, l_discount double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for q, d, p in rows:
        a, b = None if q is None else q >= 25, None if d is None else d >= 0.05
        for level, x, y in ((0, a, b), (1, None, b), (2, a, None), (3, None, None)):
            x = want.setdefault((a if level in (0, 2) else None, y, level), [[], set()])
            x[0].append(q)
            x[1].add(p)
    plain = sorted(((k, sum(q for q in qs if q is not None) if any(q is not None for q in qs) else None, len(ps - {None})) for k, (qs, ps) in want.items()), key=repr)
    got = registry.QUERIES["probe_cube"](spark, str(tmp_path))
    assert sorted((((r.a, r.b, r.level), r.mass, r.probes) for r in got.collect()), key=repr) == plain
    assert "Expand" not in _plan(got)[0]


def test_records_are_dealt_before_they_are_sorted(spark, tmp_path, monkeypatch):
    from tessera.operators import lineage
    from tessera.sources import tables

    monkeypatch.setattr(lineage, "TASK_ROWS", 8)
    (tmp_path / "x.fastq").write_text("".join(f"@r{k} x\n{'ACGT'[: k % 4 + 1]}\n+\n{'IIII'[: k % 4 + 1]}\n" for k in range(30)))
    got = tables.read_fastq(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((f"r{k}", "ACGT"[: k % 4 + 1], "IIII"[: k % 4 + 1]) for k in range(30))
    assert "REPARTITION_BY_NUM" in _plan(got)[1]


def test_components_of_dealt_rows(spark, monkeypatch):
    from tessera.operators import components as module

    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(40)] + [(rng.randint(200, 280), rng.randint(200, 280)) for _ in range(50)] + [(300, 300)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    monkeypatch.setattr(module, "dealt", lambda df, *keys, rows: df.repartition(3, *keys))
    got = module.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(label.items())

"""Every stage and operator on nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""

import random

import pytest

import corpus_pipeline
from tessera.llm import toxicity, url_filter
from tessera.llm.io import keep

SF = "/root/testdata/sf0.001"
EXTRA = "_stay _id _copies _again _bad mark id flag word bits src total rows number lead size row spans source_size gone_mark Id_".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["some", "words", "of", "plain", "text", "that", "goes", "on", f"w{rng.randrange(500)}"]) for _ in range(n))
    long, text = some(40_000), some(200)
    rows = [(None, None, None), (None, text, "a"), (None, text, "a"), (1, None, "a"), (2, "", "b"), (3, "x" * 200_000, "b"), (4, long, "a"), (5, long, "b"), (6, text, None), (6, text, None), (6, some(90), "a"), (7, "\x0b \n", "c")]
    rows += [(10 + k, some(rng.randint(25, 120)), rng.choice("abc")) for k in range(40)]
    schema = "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{x} int" for x in EXTRA)
    return spark.createDataFrame([(*r, "en", 5, *range(len(EXTRA))) for r in rows], schema).repartition(3).cache(), rows


def test_stages_keep_columns_and_lose_nothing_else(spark, docs):
    df, rows = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        got = out.collect()
        known = {(r[0], r[1]) for r in rows}
        assert got and all((r.doc_id, r.text) in known for r in got)
        if name == "benchmark_decontamination":
            assert len(got) == len(rows)
        if name == "near_duplicates":
            ids = sorted(r.doc_id for r in got if r.doc_id is not None)
            assert 5 not in ids and ids.count(6) == 2 and 4 in ids and {1, 2, 7} <= set(ids)  # a copy goes, a repeated row is one
            assert sum(r.doc_id is None for r in got) == 2


def test_stages_in_turn(spark, docs):
    df, _ = docs
    current = df
    for name, stage in corpus_pipeline.STAGES:
        before, current = current, keep(stage(spark, current, SF), name)
        assert name == "token_output" or current.columns == df.columns
    assert current.count() == before.count()


def test_toxicity_of_long_texts_and_clashing_columns(spark, docs):
    df, rows = docs
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(50)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    got = toxicity.score(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_urls_that_repeat_or_are_very_long(spark):
    long = "http://y.net/" + "/".join(f"s{k}" for k in range(60)) + "/" + "z" * 50_000
    urls = [long, long, "http://y.net/de/1", "http://y.net/de/1", None, None, "http://a.com/de/1"]
    pages = spark.createDataFrame([(k // 2, u, 1, 2, 3) for k, u in enumerate(urls)], "page_id long, url string, _h int, node int, now int")
    got = url_filter.judge_urls(pages).collect()
    by = {}
    for r in got:
        by.setdefault((r.page_id, r.path), set()).add((r.host, r.rule, r.verdict, r.template, r.purity))
    assert len(got) == len(urls) and all(len(x) == 1 for x in by.values()) and any(r.path == long[12:] for r in got)

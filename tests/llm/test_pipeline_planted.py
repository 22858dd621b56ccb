"""The whole pipeline over a planted corpus: what must go goes, what is clean stays, and the token files hold just that."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ko", "mi", "ru", "se") for b in ("lan", "tor", "ven", "dis", "por", "gal") for c in ("", "en", "is", "ol", "um")]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = some(40)
    docs, kind = [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", f"s{len(docs) % 4}", len(text or "")))

    for _ in range(150):
        add(some(rng.randint(60, 160)) + ".\n" + some(20), "clean")
    for k in range(60):
        add(" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in some(80).split()), "junk")
    base = some(200).split()
    for k in range(12):
        text = list(base)
        text[17 * k] = "other"
        add(" ".join(text), "near" if k else "near lead")
    add(docs[3][1], "copy")
    for _ in range(5):
        add(some(60) + " " + passage + " " + some(60), "contaminated")
    add(some(400) + " " + passage[: passage.index(" ", 60)] + " " + some(400), "clean")  # some words of it, no window
    add("short text", "short")
    add(None, "short")
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(x != "junk"), 0) for d, x in kind.items() if d % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", some(30))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), kind, {d[0]: d[1] for d in docs}


def test_stages_on_planted_cases(spark, planted):
    folder, kind, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, ids = {}, set(kind)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.keep(stage(spark, docs, folder), name)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        gone[name], ids = {kind[d] for d in ids - left}, left
    assert gone == {"quality_rules": {"junk", "short"}, "near_duplicates": {"near", "copy"}, "benchmark_decontamination": {"contaminated"}}
    assert {kind[d] for d in ids} == {"clean", "near lead"}


def test_pipeline_writes_what_is_left(spark, planted):
    folder, kind, texts = planted
    got = corpus_pipeline.run(spark, folder).collect()
    clean = {d for d, x in kind.items() if x in ("clean", "near lead")}
    taken = {r.doc_id for r in got}
    assert taken <= clean and len(taken) > 0.8 * len(clean)  # the mix takes about one and a half times the words, no source over twice
    words = lambda d: len(texts[d].split())
    assert sum(words(r.doc_id) for r in got) == pytest.approx(1.5 * sum(words(d) for d in clean), rel=0.1)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in got)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:])) and ordered[0].start == 0
    for d in taken:
        assert len({(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d}) == 1


@pytest.mark.parametrize("empty", ["labels", "benchmark"])
def test_pipeline_with_an_empty_table_beside_documents(spark, planted, tmp_path, empty):
    folder, kind, _ = planted
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.where(F.lit(False) if name == empty else F.lit(True)).write.parquet(f"{tmp_path}/{name}.parquet")
    taken = {kind[r.doc_id] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert "clean" in taken and ("junk" in taken) == (empty == "labels") and ("contaminated" in taken) == (empty == "benchmark") and not taken & {"short", "copy"}

"""The near-duplicate stage links by five words and 0.8."""

import corpus_pipeline


def test_stage_drops_pairs_of_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(300)]
    less = list(base)
    for p in range(10, 290, 40):  # seven edits: 261 of 331 shingles of five words
        less[p] = f"y{p}"
    more = list(base)
    for p in range(15, 290, 50):  # six edits: 266 of 326 of five words (0.82), 280 of 316 of three (0.886)
        more[p] = f"z{p}"
    texts = [" ".join(x) for x in (base, more, less)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_stage_keeps_one_of_repeated_rows_and_all_columns(spark):
    words = lambda k: " ".join(f"{k}_{i}" for i in range(40))
    rows = [(1, words("a"), "x", 3), (1, words("a"), "x", 3), (2, words("a"), "y", 4), (2, words("b"), "z", 5), (None, words("c"), "n", 6), (3, None, "e", 7), (4, "", "e", 8), (5, words("d"), "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, flag int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.select("flag").collect()) == [(3,), (5,), (6,), (7,), (8,), (9,)]

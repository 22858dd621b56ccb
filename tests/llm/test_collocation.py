"""Collocations against a plain count: nulls, empty and long texts, ties, repeated rows, several languages and an empty table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import collocation
from tessera.llm import textkernel as tk


def _plain(rows, most, least, top, covered):
    out = []
    by = {}
    for text, lang in rows:
        by.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in by.items():
        f = Counter()
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
        total = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        kept = []
        for k, a in candidates.items():
            longer = max((v for x, v in candidates.items() if len(x) > len(k) and any(x[i : i + len(k)] == k for i in range(len(x)))), default=0)
            if longer and 100 * longer >= covered * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
            kept.append((-score, -a, " ".join(k).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def _rows(seed=2):
    rng = random.Random(seed)
    vocab = ["a", "b", "Cé", "d-e", "The", "the", "x\x0by", "nb sp", "ﬀ"]
    some = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for _ in range(n))
    rows = [(some(rng.randint(0, 60)), rng.choice(["en", "en", "en", "é", None, "und", ""])) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \t.", "en"), ("the " * 900, "en"), (" ".join(vocab) * 3, "en"), ("w" * 40_000 + " w", "de"), (some(4000), "en")]
    return rows + rows[:5]


@pytest.mark.parametrize("most, least, top, covered, bounds", [(3, 3, 2000, 50, {}), (3, 2, 7, 100, {"words_at_once": 50, "bucket_bytes": 20_000, "fan": 4}), (4, 4, 2000, 30, {"words_at_once": 300}), (2, 3, 5, 50, {})])
def test_collocations(spark, most, least, top, covered, bounds):
    rows = _rows()
    df = spark.createDataFrame([(t, x, 1, "p", 2) for t, x in rows], "text string, lang string, size int, phrase string, f int").repartition(4)
    got = collocation.collocations(df, most, least, top, covered, **bounds)
    assert sorted(map(tuple, got.collect())) == _plain(rows, most, least, top, covered)


def test_no_rows(spark):
    assert collocation.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocation.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. ,\n", max_size=300), min_size=1, max_size=1), st.integers(5, 40))
def test_parts_of_a_long_text_end_at_marks(texts, limit):
    buf = np.frombuffer(texts[0].encode(), np.uint8)
    got = list(tk.parts(buf, np.array([0, len(buf)]), collocation._PIECE_END, limit))
    assert b"".join(p.tobytes() for p, _ in got) == buf.tobytes()
    assert all(collocation._PIECE_END[p[-1]] for p, _ in got[:-1])
    assert all(o.tolist() == [0, len(p)] for p, o in got if len(p))

"""The factorisation machine against all pairs, its gradients, long texts in parts, held-out accuracy and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality_fm as fm
from tessera.llm import textkernel as tk


def _texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"word{k}" for k in range(300)] + ["the", "of", "and"] * 20)
    out, good = [], []
    for k in range(n):
        w = rng.choice(vocab, rng.integers(20, 90)).tolist()
        kind = k % 6
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            w = [x for x in w[:10] for _ in range(6)]
        out.append(" ".join(w) + (".\n" + " ".join(w[:9]) if kind != 3 else ""))
        good.append(kind > 1)
    return out, np.array(good)


def _observed(texts):
    got = list(fm.observed(pa.array(texts, pa.string())))
    sums = {k: np.concatenate([g[2][k] for g in got]) for k in got[0][2]}
    return sums, np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])


def test_pairs_and_gradients():
    texts, good = _texts(12)
    sums, words, count = _observed(texts)
    stated = np.array([np.nan, 5.0] * 6)
    m = fm.Machine(np.sort(np.random.default_rng(0).random((len(fm.STATISTICS), fm.BINS - 1)), axis=1))
    m.weight[:] = np.random.default_rng(1).standard_normal(m.size)
    m.vector = np.random.default_rng(2).standard_normal((m.size, fm.RANK))
    row, value, total = m.features(sums, words, count, stated)
    z = m.logits(row, value, total)[0]
    at = np.cumsum(total) - total
    for d in range(len(texts)):
        r, x = row[at[d] :][: total[d]], value[at[d] :][: total[d]]
        pairs = sum(x[i] * x[j] * (m.vector[r[i]] @ m.vector[r[j]]) for i in range(len(r)) for j in range(i))
        assert z[d] == pytest.approx(m.bias + m.weight[r] @ x + pairs, rel=1e-4)
    y = good.astype(np.float32)
    m.weight, m.vector = m.weight.astype(float) / 20, m.vector / 20
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * m.logits(row, value, total)[0])))
    u, gw, gv, _ = m.gradients(row, value, total, y)
    for k in (0, len(u) // 2, len(u) - 1):
        for part, g in ((m.weight, gw[k]), (m.vector[:, 3], gv[k, 3])):
            was = part[u[k]]
            part[u[k]] = was + 1e-4
            up = loss()
            part[u[k]] = was - 1e-4
            down = loss()
            part[u[k]] = was
            assert (up - down) / 2e-4 == pytest.approx(g, abs=2e-4)


def test_statistics_and_long_texts(monkeypatch):
    text = "The the dog\n\nThe the dog\n  12 a!b # Éa\nx"
    sums, _, count = _observed([text, None, ""])
    got = {k: v[0] for k, v in sums.items()}
    assert got["words"] == 11 and got["lines"] == 4 and got["distinct_lines"] == 3 and got["plain"] == 1 and got["again"] == 0
    assert got["upper"] == 2 and got["digits"] == 2 and got["marks"] == 1 and got["symbols"] == 1 and got["bytes"] == got["points"] + 1 == len(text.encode())
    assert got["distinct"] == count[0] <= 8 and all(v[1] == v[2] == 0 for v in sums.values())
    rng = np.random.default_rng(3)
    long = "\n".join(" ".join(rng.choice([f"w{k}" for k in range(60)], 9)) for _ in range(400))
    long += "\n" + long[:3000]
    whole = _observed([long])
    parts, chunks = tk.parts, tk.chunks
    monkeypatch.setattr(tk, "parts", lambda b, o, t: parts(b, o, np.arange(256) == 0x0A, 900))
    cut = _observed([long])
    monkeypatch.setattr(tk, "chunks", lambda column: chunks(column, 900))
    assert all((whole[0][k] == cut[0][k]).all() for k in whole[0] if k != "again") and (whole[1] == cut[1]).all()
    texts = [long, "a b", None, long[:2000]]
    several = _observed(texts)
    monkeypatch.undo()
    plain = _observed(texts)
    assert all((several[0][k] == plain[0][k]).all() for k in plain[0] if k != "again") and (several[1] == plain[1]).all()


EXTRA = "score double, held_out int, word_rows string, stated string, words int, predicted string"


def test_fit_and_score(spark):
    texts, good = _texts(900)
    rows = [(k, t, len(t), 0.0, 1, "x", "y", 2, "z") for k, t in enumerate(texts)]
    rows += [(1000, None, None, *rows[0][3:]), (1001, "", 0, *rows[0][3:]), (None, texts[2], 7, *rows[0][3:]), (1002, "x" * 300_000, -5, *rows[0][3:]), (5, texts[5], len(texts[5]), *rows[0][3:])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars int, {EXTRA}").repartition(4)
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)] + [(3, None), (None, 0)], "doc_id long, quality int")
    got = fm.score(docs, fm.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert 200 < len(known) < 400 and np.mean([r.predicted == good[r.doc_id] for r in known]) > 0.97
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    again = {r.doc_id: r.score for r in fm.score(docs, fm.fit(docs, labels)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert fm.score(docs.limit(0), fm.fit(docs, labels)).count() == 0
    none = fm.fit(docs, labels.limit(0))
    assert {r.score for r in fm.score(docs, none).collect()} == {0.5}
    assert fm.score(docs.select("doc_id", "text"), fm.fit(docs.select("doc_id", "text"), labels)).count() == len(rows)

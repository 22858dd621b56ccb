"""Kernels against plain Python on random input."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard_join as jj
from tessera.llm import recompress as rc
from tessera.llm import textkernel as tk
from tessera.llm.fmindex import FMIndex

TEXT = st.text(alphabet="ab Zé\n\t\x0b1.", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    got = []
    for _, _, buf, offs in tk.chunks(pa.array(texts, pa.string()), limit):
        starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
        h = tk.hash_words(buf, starts, ends)
        for d in range(len(offs) - 1):
            own = [bytes(buf[starts[k] : ends[k]]).decode() for k in range(first[d], first[d + 1])]
            got.append(own)
            for k, w in zip(range(first[d], first[d + 1]), own):
                raw = np.frombuffer(w.encode(), np.uint8)
                assert h[k] == tk.hash_words(raw, np.array([0]), np.array([len(raw)]))[0]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all_occurrences(text, phrases):
    index = FMIndex(np.array(text), 3)
    rows = np.zeros((len(phrases), 4), np.int64)
    for k, p in enumerate(phrases):
        rows[k, : len(p)] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == want


@pytest.mark.parametrize("alphabet", [1, 2, 5, 50])
def test_equal_windows_hold_the_same_inner_symbols(alphabet):
    rng = np.random.default_rng(alphabet)
    words = tk.mix(rng.integers(0, alphabet, 600).astype(np.uint64) + np.uint64(9))
    doc = np.repeat(np.arange(6), 100)
    words[130:170], words[330:370] = words[30:70], words[30:70]
    s = rc.recompress(words, doc, 3)
    assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
    inner = lambda i: {(int(n), int(b) - i) for n, b, lo, hi in zip(s.name, s.begin, s.low, s.high) if lo >= i and hi <= i + 13}
    seen = {}
    for d in range(6):
        for i in range(100 * d, 100 * d + 88):
            key = words[i : i + 13].tobytes()
            assert seen.setdefault(key, inner(i)) == inner(i)


def _jaccard(a, b, limit=90):
    return 100 * len(a & b) >= limit * len(a | b)


@pytest.mark.parametrize("limit", [90, 80])
@pytest.mark.parametrize("size", [1, 4, 5, 8, 9, 10, 12, 20, 45, 300])
def test_linked_sets_share_a_pivot(size, limit):
    rng = random.Random(size)
    for _ in range(40):
        base = {rng.getrandbits(63) for _ in range(size)}
        other = set(base)
        for x in rng.sample(sorted(base), min(size - 1, rng.randint(0, size * (100 - limit) // limit + 1))):
            other.discard(x)
            if rng.random() < 0.5:
                other.add(rng.getrandbits(63))
        if not _jaccard(base, other, limit):
            continue
        flat = np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in (base, other)])
        _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        point, doc = jj.rarest(flat, np.where(count > 1, 4, 0)[back], np.array([len(base), len(other)]), limit)
        assert set(point[doc == 0].tolist()) & set(point[doc == 1].tolist())


@pytest.mark.parametrize("sided", [False, True])
def test_regions_are_joined_exactly(sided):
    rng = random.Random(3)
    base = [{rng.randrange(1 << 40) for _ in range(rng.choice([5, 10, 30]))} for _ in range(8)]
    sets = [set(list(b)[rng.randint(0, 2) :]) | {rng.randrange(1 << 40) for _ in range(rng.randint(0, 2))} for b in base for _ in range(5)]
    side = np.array([k % 2 if sided else 2 for k in range(len(sets))])
    copies = np.array([rng.randint(1, 4) for _ in sets])
    root, links = jj.join_region(np.array([len(s) for s in sets]), np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), side, copies, references=2)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if _jaccard(sets[a], sets[b]) and (not sided or side[a] != side[b])]
    want, label = [0] * len(sets), list(range(len(sets)))
    for a, b in pairs:
        want[a] += copies[b]
        want[b] += copies[a]
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    assert links.tolist() == want and root.tolist() == label

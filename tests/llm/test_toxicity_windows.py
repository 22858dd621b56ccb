"""Every window and every byte of a text is scored."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import textkernel as tk
from tessera.llm import toxicity


def _words(*texts):
    c = next(tk.chunks(pa.array(texts)))
    return toxicity.Words(c[2], c[3])


def _network(w):
    net = toxicity.Network(w.hash[:20], np.linspace(-3, 3, 20))
    rng = np.random.default_rng(4)
    net.p["char"] = rng.standard_normal(net.p["char"].shape).astype(np.float32)
    return net


def test_documents_have_the_largest_logit_of_all_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (100, 0, 5, 24, 23, 25, 1, 63)]
    w = _words(*texts)
    net = _network(w)
    got = net.top_logits(w)
    _, proj = net.inputs(w, net.rows(w.hash))
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        own = w.which[a:b]
        if not len(own):
            assert got[d] == -np.inf
            continue
        at = [np.pad(own[k : k + 24], (0, max(0, 24 - len(own))), constant_values=-1) for k in range(max(1, len(own) - 23))]
        assert abs(got[d] - net.forward(proj, np.array(at)).max()) < 1e-4


@pytest.mark.parametrize("size", [10, 14, 19, 24])
def test_a_passage_at_any_offset_is_seen_whole(size):
    passage = " ".join(f"p{k}" for k in range(size))
    for offset in range(33):
        text = " ".join([*(f"a{k}" for k in range(offset)), passage, *(f"b{k}" for k in range(60))])
        w = _words(text)
        net = _network(w)
        _, proj = net.inputs(w, net.rows(w.hash))
        k = min(offset, offset + size + 60 - 24)
        assert net.top_logits(w)[0] >= net.forward(proj, w.which[None, k : k + 24])[0] - 1e-4


def test_long_words_are_read_to_their_end():
    long = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    w = _words(long)
    assert len(w.which) == -(-len(long.encode()) // toxicity.PIECE)
    grams = lambda t: set(_words(t).gram.tolist())
    whole = grams(long)
    assert len(w.gram) == 2 * len(long.encode())
    # the runs of any part but those at its ends are among those of the whole, wherever pieces end
    raw = long.encode()
    for k in range(0, 50):
        part = raw[3 * k : 3 * k + 24].decode()
        own = _words(part).gram.reshape(-1, 2)
        assert set(own[1:-1, 0].tolist()) | set(own[4:, 1].tolist()) <= whole
    changed = long[:-1] + "x"
    assert grams(changed) != whole and grams("ab" * 12) and _words("short words").hash.tolist() == _words("words short").hash.tolist()


def test_scoring_takes_an_exponential_per_activation_but_none_for_the_first_word_of_a_window(monkeypatch):
    class Counting:
        def __init__(self):
            self.n = {"exp": 0, "tanh": 0}

        def __getattr__(self, name):
            f = getattr(np, name)
            if name not in self.n:
                return f

            def counted(x, *args, **kwargs):
                self.n[name] += np.size(x)
                return f(x, *args, **kwargs)

            return counted

    w = _words(" ".join(f"w{x}" for x in np.random.default_rng(5).integers(0, 60, 1000)))
    net, counting = _network(w), Counting()
    monkeypatch.setattr(toxicity, "np", counting)
    net.top_logits(w)
    h, size = toxicity.HIDDEN, toxicity.WINDOW
    windows = 1000 - size + 1
    assert counting.n["tanh"] == 0  # which cost numpy about twice an exponential
    assert 0 < counting.n["exp"] <= windows * (2 * 3 * h * (size - 1) + size) + 2 * 2 * h * len(w.hash)


@pytest.mark.filterwarnings("error")
@pytest.mark.parametrize("grown", [1, 30, 1000])
def test_saturated_gates_and_states_score_as_forward(grown):
    w = _words(" ".join(f"w{x}" for x in np.random.default_rng(6).integers(0, 60, 200)))
    net = _network(w)
    net.p["in"] *= np.float32(grown)
    _, proj = net.inputs(w, net.rows(w.hash))
    assert grown == 1 or 2 * np.abs(proj).max() > 89  # beyond the exponents of single precision
    each, maps, squarings = net._tables(proj)
    got = net._run(np.ascontiguousarray(each[w.which].T), len(w.which) - 23, maps, squarings)
    want = net.forward(proj, np.array([w.which[k : k + 24] for k in range(len(w.which) - 23)]))
    assert np.abs(got - want).max() < 1e-4


@pytest.mark.parametrize("squarings", [4, 5, 7])
def test_powers_give_gates_at_single_precision_as_far_as_exponents_reach(squarings):
    x = np.linspace(-10, 10, 20_001, dtype=np.float32) * 2**squarings  # the range that _tables allows for
    got = (x / np.float32(6 << squarings)).astype(np.float32)
    with np.errstate(over="ignore"):
        want = 1 / (1 + np.exp(-x.astype(float)))[::-1]
    toxicity.Network._powers(got, np.empty_like(got), np.empty_like(got), squarings)
    assert np.abs(1 / got - want).max() < 1e-6 * 2 ** (squarings - 4)


def test_few_exponentials_are_taken_and_large_recurrent_weights_take_more_squarings(monkeypatch):
    taken, exp = [], np.exp

    class Counting:
        def __getattr__(self, name):
            return (lambda x, *args, **kwargs: (taken.append(np.size(x)), exp(x, *args, **kwargs))[1]) if name == "exp" else getattr(np, name)

    w = _words(" ".join(f"w{x}" for x in np.random.default_rng(7).integers(0, 60, 1000)))
    net = _network(w)
    assert net._tables(net.inputs(w, net.rows(w.hash))[1])[2] == 4
    monkeypatch.setattr(toxicity, "np", Counting())
    net.top_logits(w)
    monkeypatch.undo()
    # those of attention, and of the first state of a distinct word
    assert sum(taken) <= (1000 - toxicity.WINDOW + 1) * toxicity.WINDOW + 2 * 2 * toxicity.HIDDEN * len(w.hash)
    net.p["uf"] *= np.float32(40)
    _, proj = net.inputs(w, net.rows(w.hash))
    each, maps, squarings = net._tables(proj)
    assert squarings > 4 and np.isfinite(net._run(np.ascontiguousarray(each[w.which].T), 1000 - 23, maps, squarings)).all()

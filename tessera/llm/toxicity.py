"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all windows of a text.

A word's input is a learned vector of the word, if training saw it often enough, beside the scaled sum of learned vectors
of its runs of three and five bytes. A word of more than ``PIECE`` bytes is read as pieces of so many, which share the runs
across their ends, so none of its bytes is left out. A window of ``WINDOW`` words begins at every word that has so many
from it on (a shorter text is one window); each gets a logit and a document's score is that of its most toxic window.
For training alone, windows are drawn from those that begin every ``STRIDE`` words. The network is fitted on the driver from a bounded sample of labelled
documents: windows are first chosen by the log-odds of their words, then by the network itself with the hardest windows
of clean documents. The last bias makes 0.5 the best document threshold on the fitting rows.

Defined cases: a null or empty text, or one without letters or digits, scores the smoothed rate of toxic documents among
the fitting rows (at most 0.49); without labels of both kinds every document does, or 0.25 without any labels; repeated
rows score alike; an empty table gives no rows. Only doc_id and text are read; labels serve fitting alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import map_batches, table

#: Words of a window, words between the windows that training draws from, and bytes of a piece of a word.
WINDOW, STRIDE, PIECE = 24, 16, 24
#: Windows that are scored at once.
BLOCK = 8192
HIDDEN, WORD_DIM, CHAR_DIM = 8, 12, 8
#: Rows of the character table, and the words that have a vector of their own, at most.
TRIGRAMS, VOCABULARY = 1 << 14, 20_000
#: Documents that must hold a word with its own vector; pseudo-documents that shrink its log-odds; decay of the weights.
OWN_DOCUMENTS, SHRINK, DECAY = 4, 4.0, 0.02
#: Steps of training in each phase at least, however few the documents.
LEAST_STEPS = 100
#: Labelled documents that fitting uses at most of each kind, and the bytes of text of one.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1500, 3000, 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Words:
    """The distinct words of a chunk: hashes, trigram rows, and each word's number among them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        buf = tk.lower(buf)
        starts, ends, first = tk.words(buf, offs, tk.ALNUM)
        # words in pieces; runs look over the ends of a piece at the bytes of its word
        count = -(-(ends - starts) // PIECE)
        self.first = np.concatenate([[0], np.cumsum(count)])[first]
        word_start, word_end = np.repeat(starts, count), np.repeat(ends, count)
        starts = word_start + PIECE * (np.arange(len(word_start)) - np.repeat(np.cumsum(count) - count, count))
        ends = np.minimum(starts + PIECE, word_end)
        left, right = np.minimum(starts - word_start, 4), np.minimum(word_end - ends, 1)
        h = tk.hash_words(buf, starts - left, ends + right) + (left + 8 * right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.hash, some, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.which = self.which.astype(np.int32)
        # runs of three and of five bytes of each distinct word, with marks at its ends
        s, size, left, right = starts[some], ends[some] - starts[some], left[some], right[some]
        head = np.cumsum(size) - size
        offset = np.arange(size.sum()) - np.repeat(head, size)
        place = np.repeat(s, size) + offset
        c = buf[place].astype(np.uint32)
        after = np.full_like(c, 2)
        after[:-1] = c[1:]
        tail = head + size - 1
        after[tail] = np.where(right > 0, buf[np.minimum(place[tail] + 1, max(len(buf) - 1, 0))], 2) if len(tail) else 2
        back = offset + np.repeat(left, size)
        before = []
        for j in range(1, 5):
            before.append(np.where(back < j, 1, buf[np.maximum(place - j, 0)]).astype(np.uint32) if len(c) else c)
        three, five = (before[0] * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D)), c * np.uint32(0x27D4EB2F)
        for k, x in enumerate(before):
            five = (five ^ x) * np.uint32(0x165667B1) + np.uint32(k)
        gram = np.stack([three, five], axis=1).reshape(-1)
        gram ^= gram >> np.uint32(15)
        self.gram, self.head, self.grams = (gram % np.uint32(TRIGRAMS)).astype(np.int32), 2 * head, 2 * size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """A row of distinct-word numbers per window that training draws from, -1 where a document is shorter, and each window's
        document."""
        n = np.diff(self.first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[:-1][doc] + np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.first[1:][doc][:, None]
        return np.where(inside, self.which[np.minimum(at, max(len(self.which) - 1, 0))], -1) if len(doc) else np.zeros((0, WINDOW), np.int32), doc


class Network:
    """Parameters and passes of the recurrent network."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocab, self.prior = vocab, 0.25
        words = (0.1 * rng.standard_normal((len(vocab) + 1, WORD_DIM))).astype(np.float32)
        words[0] = 0
        words[1:, 0] = np.clip(odds, -4, 4)
        h = HIDDEN
        self.p = {
            "word": words, "char": (0.1 * rng.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32),
            "in": g(WORD_DIM + CHAR_DIM, 6 * h), "in_b": np.zeros(6 * h, np.float32), "uf": g(h, 3 * h), "ub": g(h, 3 * h),
            "att": g(2 * h), "out": g(2 * h), "out_b": np.zeros(1, np.float32),
        }

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word in the word table; 0 for words of no own vector."""
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[place] == hashes, place + 1, 0)

    def inputs(self, w: Words, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.add.reduceat(self.p["char"][w.gram], w.head, axis=0) / np.sqrt(w.grams)[:, None] if len(w.head) else np.zeros((0, CHAR_DIM), np.float32)
        x = np.concatenate([self.p["word"][row], mean.astype(np.float32)], axis=1)
        return x, x @ self.p["in"] + self.p["in_b"]

    def _cell(self, x: np.ndarray, state: np.ndarray, u: np.ndarray):
        h = HIDDEN
        a = state @ u
        gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
        return n + z * (state - n), (z, r, n, a[:, 2 * h :])

    def forward(self, proj: np.ndarray, at: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows; padding places keep the state."""
        h, (b, t) = HIDDEN, at.shape
        table_ = np.concatenate([proj, np.zeros((1, 6 * h), np.float32)])
        real = at >= 0
        full = real.all(axis=0)
        states = np.empty((t, b, 2 * h), np.float32)
        for side, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            s, u = np.zeros((b, h), np.float32), self.p["ub" if side else "uf"]
            part = np.ascontiguousarray(table_[:, 3 * h * side : 3 * h * (side + 1)])
            for k in order:
                new, kept = self._cell(part[at[:, k]], s, u)
                if tape is not None:
                    tape.append((side, k, s, kept))
                s = new if full[k] else np.where(real[:, k, None], new, s)
                states[k, :, h * side : h * (side + 1)] = s
        e = np.where(real.T, states @ self.p["att"], -30.0)
        e = np.exp(e - e.max(axis=0))
        alpha = (e / e.sum(axis=0)).astype(np.float32)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        if tape is not None:
            tape.append((states, alpha, pooled, real))
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, w: Words, row: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        h, p = HIDDEN, self.p
        x, proj = self.inputs(w, row)
        tape: list = []
        logit = self.forward(proj, at, tape)
        states, alpha, pooled, real = tape.pop()
        prob = _sigmoid(logit)
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["out"]
        da = (states * dc).sum(axis=2)
        de = alpha * (da - (alpha * da).sum(axis=0))
        de = np.where(real.T, de, 0).astype(np.float32)
        g["att"] = np.einsum("tb,tbh->h", de, states)
        ds = alpha[:, :, None] * dc + de[:, :, None] * p["att"]
        dxs = np.zeros((at.shape[1], len(at), 6 * h), np.float32)
        g["uf"], g["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
        carry = {0: np.zeros((len(y), h), np.float32), 1: np.zeros((len(y), h), np.float32)}
        for side, k, s, (z, r, n, un) in reversed(tape):
            u = p["ub" if side else "uf"]
            ok = real[:, k, None]
            total = carry[side] + ds[k, :, h * side : h * (side + 1)]
            dh = np.where(ok, total, 0)
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (s - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            back = np.concatenate([dz, dr, dn * r], axis=1)
            carry[side] = np.where(ok, dh * z + back @ u.T, total)
            g["ub" if side else "uf"] += s.T @ back
            dxs[k, :, 3 * h * side : 3 * h * (side + 1)] = np.concatenate([dz, dr, dn], axis=1)
        flat = at.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]  # padding comes first
        head = np.flatnonzero(np.diff(flat[order], prepend=-1))
        dproj = np.zeros((len(proj), 6 * h), np.float32)
        dproj[flat[order][head]] = np.add.reduceat(dxs.reshape(-1, 6 * h)[order], head, axis=0)
        g["in"], g["in_b"] = x.T @ dproj, dproj.sum(axis=0)
        dx = dproj @ p["in"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], row, dx[:, :WORD_DIM])
        g["word"][0] = 0
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], w.gram, np.repeat(dx[:, WORD_DIM:] / np.sqrt(w.grams)[:, None].astype(np.float32), w.grams, axis=0))
        loss = -np.mean(weight * np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))
        return g, float(loss)

    def window_logits(self, w: Words, at: np.ndarray) -> np.ndarray:
        _, proj = self.inputs(w, self.rows(w.hash))
        return np.concatenate([self.forward(proj, at[k : k + 4096]) for k in range(0, len(at), 4096)]) if len(at) else np.zeros(0, np.float32)

    def top_logits(self, w: Words) -> np.ndarray:
        """The largest logit among all windows of each document, minus infinity without words."""
        n, words = np.diff(w.first), len(w.which)
        _, proj = self.inputs(w, self.rows(w.hash))
        logit = np.full(words, -np.inf, np.float32)
        each, maps, squarings = self._tables(proj)
        for a in range(0, words - WINDOW + 1, BLOCK):
            b = min(a + BLOCK, words - WINDOW + 1)
            logit[a:b] = self._run(np.ascontiguousarray(each[w.which[a : b + WINDOW - 1]].T), b - a, maps, squarings)
        logit[np.arange(words) + WINDOW > np.repeat(w.first[1:], n)] = -np.inf  # windows over a document's end
        top = np.full(len(n), -np.inf)
        some = np.flatnonzero(n)
        if len(some):
            top[some] = np.maximum.reduceat(logit, w.first[:-1][some])
        short = np.flatnonzero((n > 0) & (n < WINDOW))
        for k in range(0, len(short), BLOCK):
            d = short[k : k + BLOCK]
            at = w.first[:-1][d][:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < n[d][:, None]
            top[d] = self.forward(proj, np.where(inside, w.which[np.minimum(at, words - 1)], -1))
        return top

    def _tables(self, proj: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        """What ``_run`` takes of each distinct word and of the network. A gate is 1 / (1 + e**-x) and (1 - tanh x) / 2 is
        1 / (1 + e**2x), so a word has its inputs as such exponents, and a state s is held as (1 - s) / 2. Beside its inputs a
        word has the state of either side after it as a window's first word, which is the same in all windows. The map of a
        side leads from a state, with a one below it, to its part of the exponents and to what attention and output take.
        Last come the squarings of ``_powers``. Exponents of words are clipped only where no state brings the whole one back
        within 24, and a gate is open or shut at single precision either way."""
        h = HIDDEN
        scale = np.repeat(np.array([-1, -1, 2], np.float32), h)
        reach = float(max(np.abs(self.p[k] * scale).sum(axis=0).max() for k in ("uf", "ub")))
        squarings = max(4, int(np.ceil(np.log2((24 + 2 * reach) / 10))))
        unit = np.float32(1 / (6 << squarings))
        each, maps = [np.clip(proj * np.tile(scale, 2), -24 - reach, 24 + reach)], []
        for side in (0, 1):
            own = each[0][:, 3 * h * side : 3 * h * (side + 1)]
            new = 1 / (1 + np.exp(own[:, 2 * h :]))
            each.append(new + (np.float32(0.5) - new) / (1 + np.exp(own[:, :h])))
            u = np.concatenate([self.p["ub" if side else "uf"].T * scale[:, None] * unit, *(self.p[k][None, h * side : h * (side + 1)] for k in ("att", "out"))])
            maps.append(np.concatenate([-2 * u, u.sum(axis=1, keepdims=True)], axis=1))
        each[0] *= unit
        return np.concatenate(each, axis=1), maps, squarings

    @staticmethod
    def _powers(x: np.ndarray, over: np.ndarray, under: np.ndarray, squarings: int) -> None:
        """e**(6 * 2**squarings * x) + 1 in place: Pade's quotient of second degree, squared so often; numpy's own exponential
        takes longer."""
        np.multiply(x, x, out=over)
        over += np.float32(1 / 3)
        np.subtract(over, x, out=under)
        x += over
        x /= under
        with np.errstate(over="ignore"):  # infinity, with seven squarings or more, is a shut gate
            for _ in range(squarings):
                x *= x
        x += 1

    def _run(self, x: np.ndarray, m: int, maps: list[np.ndarray], squarings: int) -> np.ndarray:
        """Logits of the ``m`` windows at the successive words of ``x``, a column per word, as ``forward`` gives them."""
        h = HIDDEN
        taken = np.zeros((WINDOW, 2, m), np.float32)
        a, state = np.empty((3 * h + 2, m), np.float32), np.ones((h + 1, m), np.float32)
        over, under = np.empty((2, 2 * h, m), np.float32)
        gates, z, r, new, s = a[: 2 * h], a[:h], a[h : 2 * h], a[2 * h : 3 * h], state[:h]
        for side, order in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
            own, before = x[3 * h * side : 3 * h * (side + 1)], order[0]
            s[:] = x[h * (6 + side) : h * (7 + side), before : before + m]
            for k in order[1:]:
                np.matmul(maps[side], state, out=a)
                taken[before] += a[3 * h :]
                gates += own[: 2 * h, k : k + m]
                self._powers(gates, over, under, squarings)
                new /= r
                new += own[2 * h :, k : k + m]
                self._powers(new, over[:h], under[:h], squarings)
                np.reciprocal(new, out=new)
                s -= new
                s /= z
                s += new
                before = k
            taken[before] += maps[side][3 * h :] @ state
        weigh, value = taken[:, 0], taken[:, 1]
        weigh -= weigh.max(axis=0)
        np.exp(weigh, out=weigh)
        value *= weigh
        return value.sum(axis=0) / weigh.sum(axis=0) + self.p["out_b"][0]

    def document_scores(self, w: Words) -> np.ndarray:
        top = self.top_logits(w)
        return np.where(np.isfinite(top), _sigmoid(np.where(np.isfinite(top), top, 0)), self.prior)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * x * x
            if k in ("word", "char"):
                p[k] *= np.float32(1 - self.rate * DECAY)
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)


def _subset(w: Words, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words that the windows hold, so that a step costs what its batch costs."""
    used, local = np.unique(at, return_inverse=True)
    shift = int(used[0] == -1)
    used = used[shift:]
    out = Words.__new__(Words)
    size = w.grams[used]
    index = np.repeat(w.head[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out.hash, out.gram, out.head, out.grams = w.hash[used], w.gram[index], np.cumsum(size) - size, size
    return out, local.reshape(at.shape) - shift


def _train(net: Network, w: Words, at: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float) -> None:
    adam, weight = _Adam(rate), np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 256):
            part = order[k : k + 256]
            own, local = _subset(w, at[part])
            row = net.rows(own.hash)
            row = np.where(rng.random(len(row)) < 0.15, 0, row)  # so that characters learn too
            net_g, _ = net.gradients(own, row, local, y[part], weight[part])
            adam.step(net.p, net_g)


def fit_network(texts: list[str], toxic: np.ndarray, seed: int = 11, epochs: tuple[int, int] = (4, 3)) -> Network:
    """A network fitted to whole labelled texts."""
    toxic = toxic.astype(np.float32)
    total = pa.array(texts, pa.string())
    chunks = list(tk.chunks(total, 1 << 62))
    w = Words(chunks[0][2], chunks[0][3]) if chunks else None
    prior = min(0.49, (toxic.sum() + 1) / (len(toxic) + 4))
    if w is None or not len(w.hash) or toxic.min() == toxic.max():
        net = Network(np.zeros(0, np.uint64), np.zeros(0))
        net.prior, net.p["out"][:] = prior, 0
        net.p["out_b"][:] = np.log(prior / (1 - prior))
        return net
    doc = tk.owner(w.first)
    pair = np.unique(doc.astype(np.int64) * len(w.hash) + w.which)
    of, word = pair // len(w.hash), pair % len(w.hash)
    df, pos = np.bincount(word, minlength=len(w.hash)), np.bincount(word, toxic[of], len(w.hash))
    rate = float(toxic.mean())
    odds = np.log((pos + SHRINK * rate) / (df - pos + SHRINK * (1 - rate))) - np.log(rate / (1 - rate))
    own = np.flatnonzero(df >= OWN_DOCUMENTS)
    own = np.sort(own[np.argsort(-df[own], kind="stable")[:VOCABULARY]])
    net, rng = Network(w.hash[own], odds[own], seed), np.random.default_rng(seed)
    net.prior = prior
    at, of = w.windows()
    if not len(at):
        return net
    some = np.where(at >= 0, np.where(df >= OWN_DOCUMENTS, odds, 0.0)[at], -9.0).max(axis=1)
    for phase, rounds in enumerate(epochs):
        if phase:
            some = net.window_logits(w, at)
        order = np.lexsort((-some, of))
        lead = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]  # each document's most suspicious window
        clean = np.flatnonzero(toxic[of] == 0)
        rest = rng.choice(clean, min(len(clean), 2 * len(lead)), replace=False) if len(clean) else clean
        hard = clean[np.argsort(-some[clean], kind="stable")[: len(lead) // 2]] if phase else clean[:0]
        chosen = np.unique(np.concatenate([lead, rest, hard]))
        _train(net, w, at[chosen], toxic[of[chosen]], max(rounds, LEAST_STEPS * 256 // len(chosen)), rng, 0.01 if phase == 0 else 0.004)
    top = net.top_logits(w)
    has = np.isfinite(top)
    value = np.sort(top[has])
    cuts = np.concatenate([[value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]])
    y = toxic[has][np.argsort(top[has], kind="stable")]
    right = np.concatenate([[0], np.cumsum(1 - y)]) + y.sum() - np.concatenate([[0], np.cumsum(y)])
    best = np.flatnonzero(right == right.max())
    net.p["out_b"] -= np.float32(cuts[best[np.argmax(np.concatenate([[0], np.diff(value), [0]])[best])]])
    return net


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_bytes: int = FIT_BYTES) -> Network:
    """Fits on the labelled documents with the smallest hash of their id: at most ``fit_toxic`` and ``fit_clean`` of them,
    each of at most ``fit_bytes`` bytes. crc32(doc_id) mod 5 = 0 is held out."""
    named = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, n: named.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, fit_toxic).unionByName(pick(0, fit_clean))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= fit_bytes)
    got = text.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(2 * (fit_toxic + fit_clean)).toPandas()  # ids bounded by the two parameters
    return fit_network(got["text"].tolist(), got["toxic"].to_numpy())


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; no shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, buf, offs in tk.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(net.document_scores(Words(buf, offs)))], ["doc_id", "score"])

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

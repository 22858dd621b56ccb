"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in its context.

Base spans are leftmost, non-overlapping matches of three patterns. A candidate is any other run of token characters of at
least ``CANDIDATE`` bytes that is not plainly a word: it has ``LONG`` bytes, or holds a digit, an upper-case letter after its
first character or one of + / _, or stands after a colon or an equals sign. The network reads all of a candidate, in pieces of ``INSIDE``
bytes with the characters around each; the candidate's probability is that of its most suspicious piece.

No table says which strings are secrets, so the labelled findings are those of the patterns: candidates inside base spans are
secrets. All others are unlabelled; they count as negatives of half the weight, for some may be secrets too. In half of the
findings the characters before the candidate are taken from others, so that the network learns the shape of a secret and
not only the keyword. Findings held out from training are also read with the characters before others: a logistic fit
calibrates the network's output on them, and the threshold is the highest that keeps the wanted recall of them. Candidates at or over it become spans of kind ``model``; base spans always stay.

Defined cases: a null or empty text has no spans; repeated rows have the same spans; without findings of both kinds no
span is added; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import map_batches, table
from .toxicity import _Adam, _sigmoid

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Shortest candidate, and shortest that may be of small letters alone.
CANDIDATE, LONG = 8, 16
#: Bytes before a piece of a candidate, of it and after it that the network reads.
BEFORE, INSIDE, AFTER = 16, 32, 8
#: Weight of what no pattern labels, beside that of the secrets.
UNLABELLED = 0.5
#: Documents that are searched for findings, those with the smallest hash of their id, and the findings used.
FIT_DOCUMENTS, FIT_FINDINGS = 20_000, 6_000
RECALL = 0.98


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX, _TOKEN, _MARKED = _table(b"0123456789abcdef"), _table(_ALNUM + b"+/_.-"), _table(b"0123456789+/_")
_UPPER, _ASSIGNS, _BETWEEN = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b":="), _table(b""" "'""")


def _classes() -> np.ndarray:
    """Characters as the network sees them: letters and digits each their own, other bytes in a few groups."""
    c = np.full(256, 1, np.uint8)
    for k, x in enumerate(_ALNUM + b"""+/_=-.:;"'@#()&%$*!?,<> """):
        c[x] = k + 3
    c[[9, 10, 13]] = 2
    return c


_SEEN = _classes()
SYMBOLS = int(_SEEN.max()) + 1

Span = tuple[int, int, int]  # start, kind, end


def base_spans(raw: bytes, low: bytes, offs: np.ndarray, buf: np.ndarray) -> list[Span]:
    """Spans of the fixed patterns in a chunk of documents, byte offsets; no span crosses documents."""
    found: list[Span] = []

    def scan(places: list[int], pattern: re.Pattern, kind: int, group: int, least: int) -> None:
        end = 0
        for p in sorted(places):
            if p >= end:
                m = pattern.match(raw, p, int(offs[np.searchsorted(offs, p, side="right")]))
                if m:
                    end = m.end()
                    if m.end(group) - m.start(group) >= least:
                        found.append((m.start(), kind, m.end()))

    def places(text: bytes, word: bytes) -> list[int]:
        out, k = [], text.find(word)
        while k >= 0:
            out.append(k)
            k = text.find(word, k + 1)
        return out

    scan([p for w in KEYWORDS for p in places(low, w)], ASSIGN, 0, 2, LEAST["assign"])
    scan(places(raw, b"AKIA"), ACCESS, 1, 0, LEAST["access"])
    starts, ends, _ = tk.words(buf, offs, _HEX)
    long = np.flatnonzero(ends - starts >= LEAST["hex"])
    found += [(int(starts[k]), 2, int(ends[k])) for k in long]
    return sorted(found)


def candidates(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = tk.words(buf, offs, _TOKEN)
    some = ends - starts >= CANDIDATE
    starts, ends = starts[some], ends[some]
    while len(starts) and (dot := (buf[ends - 1] == ord(".")) & (ends > starts)).any():  # full stops at the end
        ends = ends - dot
    n = ends - starts
    marked, upper = _count(_MARKED[buf]), _count(_UPPER[buf])
    first = offs[:-1][np.searchsorted(offs, starts, side="right") - 1] if len(starts) else starts
    before = lambda k, kind: (starts - k >= first) & kind[buf[np.maximum(starts - k, 0)]] if len(buf) else np.zeros(0, bool)
    assigned = before(1, _ASSIGNS) | (before(1, _BETWEEN) & (before(2, _ASSIGNS) | (before(2, _BETWEEN) & before(3, _ASSIGNS))))
    odd = (marked[ends] > marked[starts]) | (upper[ends] > upper[np.minimum(starts + 1, ends)])
    some = (n >= CANDIDATE) & ((n >= LONG) | odd | assigned)
    return starts[some], ends[some]


def _count(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive pieces of at most ``INSIDE`` bytes, all of a candidate being covered, and whose they are; the last one of a
    long candidate is whole and overlaps the one before."""
    count = -(-(ends - starts) // INSIDE)
    of = np.repeat(np.arange(len(starts)), count)
    begin = starts[of] + INSIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    begin = np.minimum(begin, np.maximum(ends[of] - INSIDE, starts[of]))
    return begin, np.minimum(begin + INSIDE, ends[of]), of


def views(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The characters the network reads of each piece, 0 outside the document and between the parts."""
    doc = np.searchsorted(offs, starts, side="right") - 1
    first, last = offs[:-1][doc], offs[1:][doc]
    left = starts[:, None] + np.arange(-BEFORE, 0)
    mid = starts[:, None] + np.arange(INSIDE)
    right = ends[:, None] + np.arange(AFTER)
    take = lambda at, ok: np.where(ok, _SEEN[buf[np.clip(at, 0, max(len(buf) - 1, 0))]], 0)
    return np.concatenate([take(left, left >= first[:, None]), take(mid, mid < ends[:, None]), take(right, right < last[:, None])], axis=1).astype(np.uint8)


class ConvNet:
    """Embedding, one convolution with rectified maximum and mean over places, and a logistic output."""

    WIDTH, DIM, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": (0.3 * rng.standard_normal((SYMBOLS, self.DIM))).astype(np.float32),
            "conv": (rng.standard_normal((self.WIDTH * self.DIM, self.FILTERS)) / np.sqrt(self.WIDTH * self.DIM)).astype(np.float32),
            "conv_b": np.zeros(self.FILTERS, np.float32),
            "out": (rng.standard_normal(2 * self.FILTERS) / 7).astype(np.float32), "out_b": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def logits(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        n, t = x.shape[0], x.shape[1] - self.WIDTH + 1
        e = self.p["emb"][x]
        cols = np.concatenate([e[:, k : k + t] for k in range(self.WIDTH)], axis=2).reshape(n * t, -1)
        a = np.maximum(cols @ self.p["conv"] + self.p["conv_b"], 0).reshape(n, t, -1)
        top = a.argmax(axis=1)
        peak = np.take_along_axis(a, top[:, None, :], axis=1)[:, 0]
        f = np.concatenate([peak, a.mean(axis=1)], axis=1)
        if tape is not None:
            tape.append((cols, a, top, f, t))
        return f @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        tape: list = []
        z = self.logits(x, tape)
        cols, a, top, f, t = tape[0]
        n, k = len(y), self.FILTERS
        d = ((_sigmoid(z) - y) * weight / n).astype(np.float32)
        g = {"out": f.T @ d, "out_b": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.p["out"]
        da = np.broadcast_to(df[:, None, k:] / t, a.shape).copy()
        rows = np.arange(n)[:, None]
        da[rows, top, np.arange(k)] += df[:, :k]
        da = (da * (a > 0)).reshape(n * t, k)
        g["conv"], g["conv_b"] = cols.T @ da, da.sum(axis=0)
        dc = (da @ self.p["conv"].T).reshape(n, t, self.WIDTH, self.DIM)
        de = np.zeros((n, x.shape[1], self.DIM), np.float32)
        for j in range(self.WIDTH):
            de[:, j : j + t] += dc[:, :, j]
        one_hot = np.argsort(x.reshape(-1), kind="stable")
        seen, head = np.unique(x.reshape(-1)[one_hot], return_index=True)
        g["emb"] = np.zeros_like(self.p["emb"])
        g["emb"][seen] = np.add.reduceat(de.reshape(-1, self.DIM)[one_hot], head, axis=0)
        return g

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = [self.logits(x[k : k + 2048]) for k in range(0, len(x), 2048)]
        return _sigmoid(self.scale * np.concatenate(z) + self.shift) if z else np.zeros(0)


def fit_convnet(x: np.ndarray, y: np.ndarray, recall: float = RECALL, epochs: int = 12, seed: int = 5) -> ConvNet | None:
    """A calibrated network with its threshold; None without ten findings of each kind."""
    if min(y.sum(), (1 - y).sum()) < 10:
        return None
    rng, net = np.random.default_rng(seed), ConvNet(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(order) // 4], order[len(order) // 4 :]
    if min(y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    weight = np.where(y > 0, len(y) / (2 * y.sum()), UNLABELLED * len(y) / (2 * (1 - y).sum()))
    adam = _Adam(0.01)
    for _ in range(max(epochs, 100 * 128 // len(own))):
        rng.shuffle(own)
        for k in range(0, len(own), 128):
            part = own[k : k + 128]
            seen = x[part].copy()
            swap = rng.random(len(part)) < 0.5
            seen[swap, :BEFORE] = x[rng.choice(own, int(swap.sum())), :BEFORE]
            adam.step(net.p, net.gradients(seen, y[part].astype(np.float32), weight[part]))
    moved = x[held].copy()
    moved[:, :BEFORE] = x[rng.choice(order, len(held)), :BEFORE]
    z = net.logits(moved)
    target = y[held]
    for _ in range(50):  # Newton steps of the two calibration numbers, with a small ridge
        p = _sigmoid(net.scale * z + net.shift)
        r, w = weight[held] * (p - target), weight[held] * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(r * z).sum() + 0.01 * (net.scale - 1), r.sum() + 0.01 * net.shift])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        net.scale, net.shift = net.scale - step[0], net.shift - step[1]
    good = np.sort(_sigmoid(net.scale * z + net.shift)[target > 0])
    net.threshold = float(good[int(np.floor((1 - recall) * len(good)))])
    return net


def _inside(starts: np.ndarray, ends: np.ndarray, spans: list[Span]) -> np.ndarray:
    """Which candidates overlap a span."""
    if not spans:
        return np.zeros(len(starts), bool)
    s = np.array([x[0] for x in spans])
    reach = np.maximum.accumulate(np.array([x[2] for x in spans]))
    k = np.searchsorted(s, ends, side="left") - 1
    return (k >= 0) & (reach[np.maximum(k, 0)] > starts)


def findings(docs: DataFrame) -> DataFrame:
    """The view of every piece of a candidate and whether a base span holds the candidate."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, buf, offs in tk.chunks(batch.column(1)):
            starts, ends = candidates(buf, offs)
            spans = base_spans(buf.tobytes(), tk.lower(buf).tobytes(), offs, buf)
            a, b, of = pieces(starts, ends)
            seen = views(buf, offs, a, b)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in seen], pa.binary()), pa.array(_inside(starts, ends, spans)[of].astype(np.int32))], ["seen", "secret"])

    return map_batches(docs.select("doc_id", "text"), work, "seen binary, secret int")


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_findings: int = FIT_FINDINGS) -> ConvNet | None:
    """Fits on the distinct findings of ``fit_documents`` documents; at most ``fit_findings`` reach the driver."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    text = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most fit_documents ids
    got = findings(text).distinct().orderBy(F.xxhash64("seen"), "seen", "secret").limit(fit_findings).toPandas()
    if not len(got):
        return None
    return fit_convnet(np.frombuffer(b"".join(got["seen"]), np.uint8).reshape(len(got), -1), got["secret"].to_numpy())


def scan(docs: DataFrame, net: ConvNet | None) -> DataFrame:
    """doc_id, base counts and spans, and all spans, of every whole text; no shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, buf, offs in tk.chunks(batch.column(1)):
            spans = base_spans(buf.tobytes(), tk.lower(buf).tobytes(), offs, buf)
            if net is not None:
                starts, ends = candidates(buf, offs)
                free = ~_inside(starts, ends, spans)
                starts, ends = starts[free], ends[free]
                a, b, of = pieces(starts, ends)
                most = np.zeros(len(starts))
                for k in range(0, len(a), 8192):
                    np.maximum.at(most, of[k : k + 8192], net.probabilities(views(buf, offs, a[k : k + 8192], b[k : k + 8192])))
                hit = most >= net.threshold
                spans = sorted(spans + [(int(a), 3, int(b)) for a, b in zip(starts[hit], ends[hit])])
            counts, base, every = np.zeros((3, j - i), np.int64), [""] * (j - i), [""] * (j - i)
            if spans:
                point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                own: dict[int, list[Span]] = {}
                for s in spans:
                    own.setdefault(int(np.searchsorted(offs, s[0], side="right")) - 1, []).append(s)
                for d, some in own.items():
                    zero = point[offs[d]]
                    text = [f"{KINDS[k]}:{point[a] - zero}:{point[b] - zero}" for a, k, b in some]
                    base[d] = ",".join(t for t, s in zip(text, some) if s[1] < 3)
                    every[d] = ",".join(text)
                    for _, k, _ in some:
                        if k < 3:
                            counts[k, d] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, counts), pa.array(base), pa.array(every)], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

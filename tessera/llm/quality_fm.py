"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to rows and each weighing one over the root of their number; one
row for each structure statistic, chosen by the bin its value falls in; and one for the row's only metadata that may be
read, the length that the table states for it (n_chars), by its size and by whether it is that of the text. Every
feature has a weight and a vector of ``RANK`` numbers. All pairs of features interact by the product of their vectors,
which the identity  2 * sum of x_i x_j <v_i, v_j> over i < j  =  |sum of x_i v_i|^2 - sum of x_i^2 |v_i|^2  gives in time
linear in the features.

It is fitted on the driver from the features of a bounded sample of labelled documents, by Adagrad on the logistic loss,
and its logits are calibrated on a fifth of the sample that did not train it. Scoring covers every whole text, in chunks
within the tasks that read them; a text of more than ``CHUNK_BYTES`` is read in parts that end at white space, whose
words, lines and sums are put together (two equal words on either side of such an end do not count as a repetition).

Defined cases: a null text counts as empty and has no words; it scores by its statistics and metadata like any other. A
null n_chars has a row of its own, as has a table without that column. Repeated rows score alike; an empty table gives no
rows. Without labels of both kinds every document scores their smoothed rate, 0.5 without any. Only doc_id, text and
n_chars are read, so other columns may have any name; doc_id is carried along only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import map_batches, table

#: Rows for hashed words, numbers of a vector, and bins of a statistic.
WORD_ROWS, RANK, BINS = 1 << 16, 8, 16
#: Labelled documents that fitting uses at most, and the bytes of text of one.
FIT_ROWS, FIT_BYTES = 8000, 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 1e-4

_KINDS = {"upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "marks": b"!?", "symbols": b"#*$%&|<>", "stops": b".,;:"}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
_SPACE = ~tk.NONSPACE
#: What is added up over a document, and the statistics made of the sums.
SUMS = ("words", "bytes", "points", "word_bytes", "lines", "short", "plain", "again", *_KINDS)
STATISTICS = {
    "words": lambda s: np.log1p(s["words"]),
    "word_length": lambda s: s["word_bytes"] / np.maximum(s["words"], 1),
    "words_in_line": lambda s: s["words"] / np.maximum(s["lines"], 1),
    "short_share": lambda s: s["short"] / np.maximum(s["words"], 1),
    "no_letter_share": lambda s: s["plain"] / np.maximum(s["words"], 1),
    "again_share": lambda s: s["again"] / np.maximum(s["words"], 1),
    "distinct_share": lambda s: s["distinct"] / np.maximum(s["words"], 1),
    "distinct_line_share": lambda s: s["distinct_lines"] / np.maximum(s["lines"], 1),
    "wide_share": lambda s: s["points"] / np.maximum(s["bytes"], 1),
    **{f"{k}_share": (lambda s, k=k: s[k] / np.maximum(s["word_bytes"], 1)) for k in _KINDS},
}


def _observe(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of each document, and the distinct pairs of a document with a word's row and with a line's hash."""
    starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
    h = tk.hash_words(buf, starts, ends)
    doc = tk.owner(first)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(tk.ALNUM[tk.lower(buf)], out=letters[1:])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # lines with a word: the hashes of their words with the words' places, added up
    breaks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 0x0A, out=breaks[1:])
    line = breaks[starts]
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    place = np.arange(len(h)) - (np.repeat(head, np.diff(np.append(head, len(h)))) if len(head) else 0)
    lines = np.add.reduceat(tk.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), head) if len(head) else np.zeros(0, np.uint64)
    size = ends - starts
    per = lambda x: tk.per_document(x, first)
    sums = [np.diff(first), np.diff(offs), tk.per_document((buf & 0xC0) != 0x80, offs), per(size), per(new), per(size <= 3), per(letters[ends] == letters[starts]), per(again)]
    sums += [tk.per_document(t[buf], offs) for t in _TABLES.values()]
    low = tk.lower(buf)
    a, b, f = tk.words(low, offs, tk.ALNUM)
    rows = tk.hash_words(low, a, b) % np.uint64(WORD_ROWS)
    words = np.unique(tk.owner(f).astype(np.int64) * WORD_ROWS + rows.astype(np.int64))
    order = np.lexsort((lines, doc[head]))
    of, lines = doc[head][order], lines[order]
    one = np.ones(len(of), bool)
    one[1:] = (of[1:] != of[:-1]) | (lines[1:] != lines[:-1])
    return np.stack(sums).astype(np.int64), words, np.stack([of[one].astype(np.uint64), lines[one]])


def observed(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, the sums, the words' rows and how many of them each document has."""
    for i, j, buf, offs in tk.chunks(texts):
        parts = [_observe(b, o) for b, o in tk.parts(buf, offs, _SPACE)]
        if len(parts) == 1:
            sums, words, lines = parts[0]
        else:  # of one long text
            sums, words, lines = sum(p[0] for p in parts), np.unique(np.concatenate([p[1] for p in parts])), np.unique(np.concatenate([p[2] for p in parts], axis=1), axis=1)
        got = dict(zip(SUMS, sums))
        count = np.bincount(words // WORD_ROWS, minlength=j - i)
        got["distinct"], got["distinct_lines"] = count, np.bincount(lines[0].astype(np.int64), minlength=j - i)
        yield i, j, got, words % WORD_ROWS, count


def _metadata(stated: np.ndarray, sums: dict[str, np.ndarray]) -> np.ndarray:
    """A row's number by its stated length: 0 without one, else by its size and whether the text has so many characters."""
    known = ~np.isnan(stated)
    size = np.minimum(np.log2(np.maximum(np.where(known, stated, 0), 0) + 1), 31).astype(np.int64)
    return np.where(known, 1 + 2 * size + (np.where(known, stated, -1) == sums["points"]), 0)


class Machine:
    """Edges of the bins, weights, vectors and calibration. Features: words, then bins of each statistic, then metadata."""

    def __init__(self, edges: np.ndarray, prior: float = 0.5, seed: int = 5):
        self.edges, self.prior, self.trained = edges, prior, False
        self.size = WORD_ROWS + len(STATISTICS) * BINS + 65
        self.bias, self.weight = np.float32(0), np.zeros(self.size, np.float32)
        self.vector = (0.05 * np.random.default_rng(seed).standard_normal((self.size, RANK))).astype(np.float32)
        self.slope, self.shift = 1.0, 0.0

    def features(self, sums: dict[str, np.ndarray], words: np.ndarray, count: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, values and how many each document has: its words, then a row per statistic and one of metadata."""
        n, more = len(count), len(STATISTICS) + 1
        fixed = np.empty((n, more), np.int64)
        for k, f in enumerate(STATISTICS.values()):
            fixed[:, k] = WORD_ROWS + k * BINS + np.searchsorted(self.edges[k], f(sums), side="right")
        fixed[:, -1] = WORD_ROWS + len(STATISTICS) * BINS + _metadata(stated, sums)
        total = count + more
        begin = np.cumsum(total) - total
        row, value = np.empty(total.sum(), np.int64), np.ones(total.sum(), np.float32)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(words))
        row[at], value[at] = words, np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
        row[(begin + count)[:, None] + np.arange(more)] = fixed
        return row, value, total

    def logits(self, row: np.ndarray, value: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document the logit and the sum of its vectors; and the weighted vectors. Every document has a feature."""
        begin = np.cumsum(total) - total
        xv = self.vector[row] * value[:, None]
        s = np.add.reduceat(xv, begin, axis=0)
        pairs = 0.5 * (s * s - np.add.reduceat(xv * xv, begin, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[row] * value, begin) + pairs, s, xv

    def gradients(self, row: np.ndarray, value: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The rows that a batch has, and the gradients of the mean loss by their weights and vectors and by the bias."""
        z, s, xv = self.logits(row, value, total)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        each = np.repeat(d, total) * value
        gv = each[:, None] * (np.repeat(s, total, axis=0) - xv)
        order = np.argsort(row, kind="stable")
        head = np.flatnonzero(np.diff(row[order], prepend=-1))
        return row[order][head], np.add.reduceat(each[order], head), np.add.reduceat(gv[order], head, axis=0), float(d.sum())

    def train(self, row: np.ndarray, value: np.ndarray, total: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        rng, begin = np.random.default_rng(seed), np.cumsum(total) - total
        seen_w, seen_v, seen_b = np.full(self.size, 1e-4, np.float32), np.full((self.size, RANK), 1e-4, np.float32), 1e-4
        self.bias = np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                d = order[k : k + BATCH]
                n = total[d]
                at = np.repeat(begin[d] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                u, gw, gv, gb = self.gradients(row[at], value[at], n, y[d])
                gw, gv = gw + DECAY * self.weight[u], gv + DECAY * self.vector[u]
                seen_w[u] += gw * gw
                seen_v[u] += gv * gv
                seen_b += gb * gb
                self.weight[u] -= np.float32(RATE) * gw / np.sqrt(seen_w[u])
                self.vector[u] -= np.float32(RATE) * gv / np.sqrt(seen_v[u])
                self.bias -= np.float32(RATE * gb / np.sqrt(seen_b))

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the logits by Newton's method, towards rates that no label is sure of."""
        good = (y.sum() + 1) / (y.sum() + 2)
        target = np.where(y > 0, good, 1 / (len(y) - y.sum() + 2))
        x, at = np.stack([z, np.ones_like(z)], axis=1).astype(float), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target))
            at = at - np.clip(step, -1, 1)
        if at[0] > 0:
            self.slope, self.shift = float(at[0]), float(at[1])

    def scores(self, sums: dict[str, np.ndarray], words: np.ndarray, count: np.ndarray, stated: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(count), self.prior)
        z = self.logits(*self.features(sums, words, count, stated))[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * z.astype(float) + self.shift, -500, 500)))


def fit_machine(sums: dict[str, np.ndarray], words: np.ndarray, count: np.ndarray, stated: np.ndarray, good: np.ndarray, seed: int = 5) -> Machine:
    """A machine fitted to labelled documents, as :func:`observed` gives them; every fifth calibrates."""
    y = good.astype(np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    values = [f(sums) for f in STATISTICS.values()]
    edges = np.stack([np.quantile(v, np.arange(1, BINS) / BINS) if len(v) else np.zeros(BINS - 1) for v in values])
    out = Machine(edges, prior, seed)
    if not len(y) or y.min() == y.max():
        return out
    row, value, total = out.features(sums, words, count, stated)
    doc = np.repeat(np.arange(len(y)), total)
    aside = np.arange(len(y)) % 5 == 4
    if min(y[aside].sum(), (1 - y[aside]).sum(), y[~aside].sum(), (1 - y[~aside]).sum()) < 2:
        aside[:] = False
    pick = lambda rows: (row[rows[doc]], value[rows[doc]], total[rows])
    out.train(*pick(~aside), y[~aside], seed=seed)
    if aside.any():
        out.calibrate(out.logits(*pick(aside))[0], y[aside])
    out.trained = True
    return out


def _stated(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("stated")


_FIT_SCHEMA = "doc_id long, stated double, word_rows array<int>, " + ", ".join(f"{c} long" for c in (*SUMS, "distinct", "distinct_lines"))


def _features_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, sums, words, count in observed(batch.column(2)):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(words.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists, *(pa.array(np.asarray(x, np.int64)) for x in sums.values())], ["doc_id", "stated", "word_rows", *sums])


def _to_learn() -> Column:
    """Rows whose labels may be learned: the others are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Machine:
    """Fits on the labelled documents with the smallest hash of their id: at most ``fit_rows`` of them, each of at most
    ``fit_bytes`` bytes, so what reaches the driver is bounded. crc32(doc_id) mod 3 = 1 is held out. Of several labels of
    an id the worst counts."""
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & _to_learn()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stated(docs), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= fit_bytes)
    got = map_batches(text.join(F.broadcast(named), "doc_id", "left_semi"), _features_of, _FIT_SCHEMA)  # at most fit_rows ids
    rows = got.join(F.broadcast(named), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "word_rows", "stated", *SUMS).limit(2 * fit_rows).toArrow()
    one = lambda c: rows.column(c).combine_chunks()
    sums = {c: one(c).to_numpy() for c in (*SUMS, "distinct", "distinct_lines")}
    words = one("word_rows")
    return fit_machine(sums, words.flatten().to_numpy().astype(np.int64), np.diff(words.offsets.to_numpy()), one("stated").cast(pa.float64()).to_numpy(zero_copy_only=False), one("quality").to_numpy() > 0)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; no shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stated = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        for i, j, sums, words, count in observed(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(machine.scores(sums, words, count, stated[i:j]))], ["doc_id", "score"])

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), _stated(docs), "text"), work, "doc_id long, score double")
    return scored.select("doc_id", (~_to_learn()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

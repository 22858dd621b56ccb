"""Quality rules: a decision list learned by sequential covering, applied as one ordered conditional expression.

Each document gets whole-text statistics. Labelled documents' statistics grow rules, conjunctions of threshold tests
that cover rejected documents; each rule is pruned on rows that did not grow it. The list becomes nested Spark
conditions, so applying it needs no Python.

Defined cases: a null or empty text has no words, so it fails the base rule; repeated rows are judged alike; an empty
table gives no rows; without labels of both kinds the list is empty and the base rule alone decides. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .io import map_batches, table

REPEAT_WINDOW = 8
#: The list is fitted on at most so many labelled documents, those with the smallest hash of their id.
FIT_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_short")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _byte_set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOLS, _UPPER, _MARKS, _DIGITS = _byte_set(b"#*$%&|<>"), _byte_set(bytes(range(0x41, 0x5B))), _byte_set(b"!?"), _byte_set(b"0123456789")


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the words in windows that the same document holds twice or more."""
    at = tk.within(first, REPEAT_WINDOW)
    if not at.size:
        return np.zeros(len(h), dtype=bool)
    key = tk.window_hash(h, REPEAT_WINDOW)[at] ^ tk.mix(tk.owner(first)[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return tk.covered(len(h), at[twice], REPEAT_WINDOW)


def _stats(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from _counted(batch.column(0), batch.column(1), "doc_id")


def _stats_of_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from _counted(batch.column(0), batch.column(0).field("text"), "row")


def _counted(carried: pa.Array, texts: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
    """The counts of each text beside what is carried along."""
    for i, j, buf, offs in tk.chunks(texts):
        starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
        repeated = _repeats(tk.hash_words(buf, starts, ends), first)
        lines, dups = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        raw = buf.tobytes()
        for d in range(j - i):
            own = [x for x in raw[offs[d] : offs[d + 1]].split(b"\n") if x and not x.isspace()]
            lines[d], dups[d] = len(own), len(own) - len(set(own))
        point = (buf & 0xC0) != 0x80
        cols = [
            np.diff(first),
            tk.per_document(point & tk.NONSPACE[buf], offs),
            tk.per_document(_SYMBOLS[buf], offs),
            dups,
            tk.per_document(repeated, first),
            lines,
            *(tk.per_document(t[buf], offs) for t in (_UPPER, _MARKS, _DIGITS)),
            tk.per_document(ends - starts <= 3, first),
        ]
        yield pa.RecordBatch.from_arrays([carried.slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols)], [name, *COUNTS])


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; no shuffle."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _stats, STATS_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: What rules test, as numerator and denominator of counts.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
    "short_share": ("n_short", "n_words"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        value = F.col(top).cast("double")
        if bottom:
            value = value / F.greatest(F.col(bottom), F.lit(1)).cast("double")
        return value >= self.threshold if self.above else value < self.threshold

    def flags(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (top, bottom) in FEATURES.items():
        out[name] = counts[top].astype(float) / (np.maximum(counts[bottom], 1).astype(float) if bottom else 1.0)
    return out


def _cover(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    keep = np.ones(len(rows), dtype=bool)
    for t in rule:
        keep &= t.flags({t.feature: x[t.feature][rows]})
    return rows[keep]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int) -> Rule:
    """Adds the test with the largest information gain until no good row is covered or no test gains."""
    rule: list[Test] = []
    while len(rule) < most:
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v = values[rows]
            cuts = np.unique(np.quantile(v, np.linspace(0.01, 0.99, 99)))
            if len(cuts) < 2:
                continue
            cuts = (cuts[1:] + cuts[:-1]) / 2
            place = np.searchsorted(cuts, v, side="right")  # cuts at or below each value
            pos = np.bincount(place, bad[rows], len(cuts) + 1)[::-1].cumsum()[::-1][1:]
            neg = np.bincount(place, ~bad[rows], len(cuts) + 1)[::-1].cumsum()[::-1][1:]
            for above, p, n in ((True, pos, neg), (False, p0 - pos, n0 - neg)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = _cover((best[1],), x, rows)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Drops final tests while (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        got = bad[_cover(r, x, rows)]
        return (2 * got.sum() - len(got)) / len(got) if len(got) else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def fit_decision_list(counts: dict[str, np.ndarray], quality: np.ndarray, *, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject. Two thirds of the rows grow rules and one third prunes them; a rule is kept if its
    smoothed precision on all rows still uncovered reaches ``precision``."""
    bad, x = quality == 0, features(counts)
    if not bad.any() or bad.all():
        return []
    order = np.random.default_rng(seed).permutation(len(bad))
    cut = 2 * len(order) // 3
    grow, prune = np.sort(order[:cut]), np.sort(order[cut:])
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[grow].sum() >= 2:
        rule = _prune(_grow(x, bad, grow, most_tests), x, bad, prune)
        got = bad[np.concatenate([_cover(rule, x, grow), _cover(rule, x, prune)])] if rule else np.zeros(0, bool)
        if len(got) < 3 or (got.sum() + 1) / (len(got) + 2) < min(precision, (len(got) + 0.8) / (len(got) + 2)):
            break
        rules.append(rule)
        grow, prune = (np.setdiff1d(r, _cover(rule, x, r)) for r in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional expression."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list from the labelled documents among ``docs``; at most ``fit_rows`` rows of counts reach the driver."""
    named = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named), "doc_id", "left_semi")  # at most fit_rows ids
    got = document_stats(text).join(F.broadcast(named), "doc_id").orderBy("doc_id", *COUNTS).limit(2 * fit_rows).toPandas()
    got = got[(got.n_words >= 20) & (100 * got.n_repeat_words <= 30 * got.n_words)]  # the base rule comes first
    return fit_decision_list({c: got[c].to_numpy() for c in COUNTS}, got["quality"].to_numpy())


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts of each document with base_failed and kept."""
    return document_stats(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep; no shuffle."""
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return map_batches(docs.select(F.struct("*").alias("row")), _stats_of_rows, schema).where(verdict(rules)).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])

"""Bases, qualities and identifiers as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def gene_id(col: Column) -> Column:
    """A gene's id without its version."""
    return F.split_part(col, F.lit("."), F.lit(1))


def capture_key(col: Column) -> Column:
    """A slide's serial and area, upper case, as serial/area; null for other text."""
    text = F.upper(F.trim(col))
    return F.when(text.rlike(r"^[A-Z0-9]+-[A-Z0-9]+/[A-D][0-9]?$"), text)


def tier_number(col: Column) -> Column:
    """3 of 'H3'; null for other text."""
    return F.when(col.rlike("^H[0-9]+$"), F.regexp_extract(col, "^H([0-9]+)$", 1).cast("int"))


def several_features(col: Column) -> Column:
    return col.rlike("[;,]")


def uncommented(col: Column) -> Column:
    """TeX without comments; an escaped percent sign stays."""
    return F.regexp_replace(col, r"(?m)(?<!\\)%.*$", "")


def clean_roundoff(col: Column, tolerance: float = 1e-5) -> Column:
    return F.when(F.abs(col) <= tolerance, F.lit(0.0)).otherwise(col)


def _digits(text: Column) -> Column:
    """A text of 0 to 3 as a number in base 4; at most 31 of them."""
    return F.conv(F.translate(text, BASES, "0123"), 4, 10).cast("decimal(20,0)")


def packed_words(sequence: Column, length: int = 50) -> Column:
    """``length`` bases as words of 25 bases each, two bits a base; null for other lengths or letters."""
    words = [_digits(F.substring(sequence, k + 1, 25)) for k in range(0, length, 25)]
    return F.when(sequence.rlike(f"^[{BASES}]{{{length}}}$"), F.array(*words))


def unpacked(value: Column, length: int) -> Column:
    """The bases of a number that holds two bits for each, the first one in the highest bits."""
    letter = lambda k: F.substr(F.lit(BASES), (F.floor(value / F.lit(4 ** (length - 1 - k))) % 4 + 1).cast("int"), F.lit(1))
    return F.concat(*(letter(k) for k in range(length)))


def error_probability(phred: Column) -> Column:
    """10^(-q/10), at least 1e-10 and at most 3/4, that of a base known to be random."""
    return F.least(F.lit(0.75), F.greatest(F.lit(1e-10), F.pow(F.lit(10.0), -phred / 10.0)))


def base_log_likelihood(observed: Column, candidate: Column, phred: Column) -> Column:
    """Log probability of an observed base given the true one; that of a random base for an unknown one."""
    e = error_probability(phred)
    known = observed.isin(*BASES) & candidate.isin(*BASES)
    return F.when(~known, F.lit(math.log(0.25))).when(observed == candidate, F.log1p(-e)).otherwise(F.ln(e / 3))


def tier_profile(left: Column, right: Column) -> Column:
    """How two halves with these edits match: direct, single_half, balanced_1_1 or mixed."""
    return F.when((left == 0) & (right == 0), "direct").when((left == 0) | (right == 0), "single_half").when((left == 1) & (right == 1), "balanced_1_1").otherwise("mixed")


def half_class(observed_length: Column, target_length: Column, distance: Column) -> Column:
    """How an observed half differs from its target: exact, one substitution, insertion or deletion, or more."""
    more = observed_length - target_length
    one = F.when(more == 0, "substitution").when(more == 1, "insertion").when(more == -1, "deletion").otherwise("multiple")
    return F.when((distance == 0) & (more == 0), "exact").when(distance == 1, one).otherwise("multiple")


def alignment_log_likelihoods(gap_q: float = 30.0, missing_q: float = 20.0):
    """A function of columns (observed, qualities, candidate): the largest log probability of an alignment of an observed
    sequence to a candidate. A pair of bases counts by its quality, a gap by ``gap_q``; a base without a quality has ``missing_q``.

    All rows of an Arrow batch take a step of the table of alignments together."""
    log_error = lambda q: math.log(min(0.75, max(1e-10, 10 ** (-q / 10))))
    gap = log_error(gap_q)

    def scores(observed: pd.Series, qualities: pd.Series, candidate: pd.Series) -> pd.Series:
        n = len(observed)
        given = [o is not None and c is not None for o, c in zip(observed, candidate)]
        own = [o if g else "" for o, g in zip(observed, given)]
        other = [c if g else "" for c, g in zip(candidate, given)]
        rows, cols = max(map(len, own), default=0), max(map(len, other), default=0)
        code = lambda texts, size: np.array([[BASES.find(t[k]) if k < len(t) else -2 for k in range(size)] for t in texts], np.int64).reshape(n, size)
        a, b = code(own, rows), code(other, cols)
        q = np.full((n, rows), missing_q)
        for i, values in enumerate(qualities):
            if values is not None and rows:
                some = np.asarray(values, float)[:rows]
                q[i, : len(some)] = np.where(np.isfinite(some), some, missing_q)
        e = np.clip(10 ** (-q / 10), 1e-10, 0.75)
        last_row, last_col = np.array([len(x) for x in own]), np.array([len(x) for x in other])
        table = np.arange(cols + 1) * gap + np.zeros((n, 1))
        out = np.where(last_row == 0, last_col * gap, -np.inf)
        for i in range(rows):
            new = np.empty_like(table)
            new[:, 0] = (i + 1) * gap
            for j in range(cols):
                pair = np.where((a[:, i] < 0) | (b[:, j] < 0), math.log(0.25), np.where(a[:, i] == b[:, j], np.log1p(-e[:, i]), np.log(e[:, i] / 3)))
                new[:, j + 1] = np.maximum(table[:, j] + pair, np.maximum(table[:, j + 1], new[:, j]) + gap)
            table = new
            out = np.where(last_row == i + 1, table[np.arange(n), last_col], out)
        return pd.Series(np.where(given, out, np.nan))

    return F.pandas_udf(scores, "double")


#: Trials up to which the chances come from a table of logarithms.
TABLE_TRIALS = 1000
#: Trials up to which the ways to split them, times a number of trials, are whole numbers that a double holds.
WHOLE_TRIALS = 40


def _stirling_rest(k: Column) -> Column:
    """log k! less its leading terms k log k - k + log(2 pi k) / 2, for k of at least 1."""
    few = F.array(*(F.lit(math.lgamma(i + 1) - (i * math.log(i) - i + math.log(2 * math.pi * i) / 2) if i else 0.0) for i in range(16)))
    x = k.cast("double")
    return F.when(k < 16, F.get(few, k.cast("int"))).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / (x * x)) / (x * x)) / (x * x)) / x)


def binomial_two_sided(wins: Column, trials: Column, table: int = TABLE_TRIALS) -> Column:
    """The exact two-sided probability of a split as uneven as this under even chances; null if there is no such split.

    It is twice the tail: the chance of the split itself, and the chances of more uneven ones by the ratios of successive
    terms, of which those beyond 5 roots of the trials are below 10^-21 of the first. Up to ``WHOLE_TRIALS`` trials the terms
    are numbers of ways, so the chance has no rounding of its own. Beyond ``table`` trials the first comes from its expansion
    around the even split, whose rounding grows with the root of the trials only."""
    logs = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(table + 1)))
    low, n = F.least(wins, trials - wins).cast("long"), trials.cast("double")
    at = lambda k: F.get(logs, k.cast("int"))
    known = F.exp(at(trials) - at(low) - at(trials - low) - n * math.log(2))
    d = (trials - 2 * low) / n
    spread = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    few = F.exp(_stirling_rest(trials) - _stirling_rest(low) - _stirling_rest(trials - low) - spread) * F.sqrt(n / (2 * math.pi * low * (trials - low)))
    first = F.when(trials <= table, known).when(low == 0, F.exp(-n * math.log(2))).otherwise(few)
    terms = F.least(low, (5 * F.sqrt(n)).cast("long") + 60)
    whole = trials <= min(table, WHOLE_TRIALS)
    own = F.when(whole, F.rint(F.exp(at(trials) - at(low) - at(trials - low)))).otherwise(1.0)
    # each step carries the term that it comes to and the sum so far
    start = F.struct(own.alias("term"), own.alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (low - j + 1) / (trials - low + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(steps, start, step)["sum"]
    scale = F.when(whole, F.pow(F.lit(2.0), -n)).otherwise(first)
    return F.when((trials >= 0) & (wins >= 0) & (wins <= trials), F.when(trials == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * scale * tail)))

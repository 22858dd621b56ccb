"""Numbers of reports: an expression tree over result rows, display forms and durations as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_expression(tree: dict | str | float, source: str = "value") -> Column:
    """A column from a tree of sum, difference, ratio, product, min, max and length over paths into a map column."""
    if isinstance(tree, str):
        return F.try_element_at(F.col(source), F.lit(tree))
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    ((name, args),) = tree.items()
    if name == "length":
        return F.size(args).cast("double")
    cols = [compile_expression(a, source) for a in args]
    if name == "ratio":
        return F.try_divide(cols[0], cols[1])
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(*cols)
    step = {"sum": lambda a, b: a + b, "difference": lambda a, b: a - b, "product": lambda a, b: a * b}[name]
    return reduce(step, cols)


def display(value: Column, style: str, digits: int = 2) -> Column:
    """text, integer with groups, decimal, scientific or duration."""
    if style == "integer":
        return F.format_number(value, 0)
    if style == "decimal":
        return F.format_number(value, digits)
    if style == "scientific":
        return F.format_string(f"%.{digits}e", value)
    if style == "duration":
        s = F.rint(value).cast("long")
        return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return value.cast("string")


def elapsed_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss or m:ss; null for other text."""
    part = lambda p, k: F.regexp_extract(text, p, k).cast("double")
    long, short = r"^(\d+):([0-5]\d):([0-5]\d(?:\.\d+)?)$", r"^(\d+):([0-5]\d(?:\.\d+)?)$"
    return F.when(text.rlike(long), part(long, 1) * 3600 + part(long, 2) * 60 + part(long, 3)).when(text.rlike(short), part(short, 1) * 60 + part(short, 2))

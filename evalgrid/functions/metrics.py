"""Column helpers for the zero-denominator rules (M10) and P/R/F1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is zero or null (ANSI-safe)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def exact_sum(c: str) -> Column:
    """Sum of scores between 0 and 1 that is the same in any order: decimals of 18 places, which 10^20 scores do not exceed."""
    return F.sum(F.col(c).cast("decimal(28,18)"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Micro P/R/F1 from summed counts; each is 0.0 when its denominator is zero."""
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    f1 = safe_div(F.lit(2.0) * p * r, p + r)
    return p, r, f1


def f_measure(p: Column, r: Column) -> Column:
    """2pr/(p+r), 0.0 when p + r = 0."""
    return safe_div(F.lit(2.0) * p * r, p + r)

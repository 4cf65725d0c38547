"""Exact-match scoring for closed tasks: M1 match flag, M2 accuracy per run cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_div
from ..functions.text import py_strip

CELL = ["model", "split", "shot"]


def match_flag(pred: Column, answer: Column, task_type: Column, mode: str = "reference") -> Column:
    """M1: prediction equals the stripped gold for mc/bool; null for open tasks.

    reference mode compares the lower-cased boolean prediction with the gold as written (Q1).
    """
    gold = py_strip(answer)
    if mode == "corrected":
        gold = F.when(task_type == "bool", F.lower(gold)).otherwise(gold)
    return F.when(task_type.isin("mc", "bool"), F.coalesce(pred == gold, F.lit(False)))


def accuracy(scored: DataFrame, items: DataFrame) -> DataFrame:
    """M2: correct / n per (model, split, shot), where n counts the split's *items*.

    Items without a response count as wrong, as in the reference (n = len(dataset)).
    Two partial aggregations and a join of two small aggregates: no items x cells product.
    """
    correct = scored.groupBy(*CELL).agg(
        F.sum(F.col("match").cast("bigint")).alias("correct"),
        F.count(F.lit(1)).alias("n_responses"),
    )
    n_items = items.groupBy("split").agg(F.count(F.lit(1)).alias("n_items"))
    return correct.join(n_items, "split", "left").select(
        *CELL,
        F.col("correct"),
        F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"),
        safe_div(F.col("correct"), F.col("n_items")).alias("accuracy"),
    )

"""Benchmark-answer evaluation on Spark.

Reads evaluation items, few-shot prompt files and raw model responses as
DataFrames, assembles prompts, parses responses into typed answers, scores
them (accuracy, tuple F1, positional triple F1, BLEU, ROUGE-1/2/L) and
reports per model x task x shot level -- every cell of a run grid in one job.
"""

__all__ = ["session", "schemas", "catalog"]

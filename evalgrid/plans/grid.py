"""The run grid (S8): models x splits x shot levels, one row per generation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import GRID_SHOTS, MAX_TOKENS_CLOSED, MAX_TOKENS_OPEN, SPLITS

# ---- fixed values: the launchers' generation settings ----
MAX_BATCHED_TOKENS = 8192
TEMPERATURE = 0.0
TOP_P = 1.0
# ---- end fixed values ----


def run_grid(models: DataFrame, splits: list[str] | None = None, shots: list[str] | None = None,
             dataset: str = "local", prompt_root: str = "./prompt") -> DataFrame:
    """Expand each model row over splits and shots with ``explode`` (generators, no join).

    Closed splits (1_*, 2_*) generate at most 128 tokens, open ones (3_*) 512.
    """
    splits = splits or SPLITS
    shots = shots or GRID_SHOTS
    g = (models.select("model").distinct()
         .withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
         .withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots]))))
    return g.select(
        F.lit(dataset).alias("dataset"), "model", "split", "shot",
        F.concat(F.lit(prompt_root + "/bench_"), F.col("split"), F.lit("/"), F.col("shot"), F.lit(".txt")).alias("prompt_path"),
        F.lit(MAX_BATCHED_TOKENS).alias("max_batched_tokens"),
        F.when(F.col("split").startswith("3_"), F.lit(MAX_TOKENS_OPEN)).otherwise(F.lit(MAX_TOKENS_CLOSED)).alias("max_tokens"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.lit(TOP_P).alias("top_p"),
    )

"""Prompt-file sources: parse one file (S3) and scan a corpus of split x shot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SHOT_LABEL_PATTERN
from ..operators.prompting import parse_prompt_text

# ---- fixed values: corpus layout ----
SPLIT_DIR_PATTERN = r"bench_(\d+_\d+)"
# ---- end fixed values ----


def parse_prompts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """S3 over a DataFrame of whole file texts: adds examples, template, valid, reason, n_parts."""
    parsed = parse_prompt_text(F.col(text_col))
    return df.select("*", *[c.alias(n) for n, c in parsed.items()])


def read_prompt_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Read every prompt file below ``root`` whole, one row per file.

    ``split`` and ``shot`` come from the file path (``_metadata.file_path``): the split from a
    ``bench_<split>`` directory, the shot from the last ``<level>_shot`` in the path, in the words of GRID_SHOTS.  Files
    that fail S3 stay in the result with ``valid = false`` -- the rejects.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
        .text(root, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    shot_any = F.regexp_extract_all(F.col("path"), F.lit(SHOT_LABEL_PATTERN), 0)
    df = raw.select(
        "path",
        F.when(F.regexp_extract("path", SPLIT_DIR_PATTERN, 1) != "", F.regexp_extract("path", SPLIT_DIR_PATTERN, 1)).alias("split"),
        F.when(F.size(shot_any) > 0, F.lower(F.element_at(shot_any, -1))).alias("shot"),
        "text",
    )
    return parse_prompts(df)


def build_prompt_corpus(items: DataFrame, max_shots: int = 4) -> DataFrame:
    """Few-shot prompt texts per (split, shot) from the items themselves.

    The exemplars of a split are its first ``max_shots`` items by ``ord``: a per-group top-k
    (``row_number() <= k``, planned with a partial window-group limit before the shuffle, so a
    hot split never sorts in one task).  Shot k uses the first k exemplars, so shot k's
    examples are a prefix of shot k+1's, as in the reference corpus.
    """
    from pyspark.sql import Window

    from ..catalog import is_mcq_split
    from ..functions.text import py_strip

    w = Window.partitionBy("split").orderBy("ord")
    top = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_shots)
    opts = F.replace(py_strip(F.coalesce(F.col("options"), F.lit(""))), F.lit("\n\n"), F.lit("\n"))
    block = F.concat(
        F.lit("Question: "), py_strip(F.col("question")), F.lit("\n"),
        F.when(is_mcq_split(F.col("split")), F.concat(opts, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("Answer: "), py_strip(F.col("answer")), F.lit("\n\n"),
    )
    ex = top.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("_rn", block.alias("b")))).alias("ex"))
    levels = F.array(*[F.lit(i) for i in range(max_shots + 1)])
    names = F.array(*[F.lit(n) for n in ["zero_shot", "one_shot", "two_shot", "three_shot", "four_shot"][: max_shots + 1]])
    out = ex.select("split", F.posexplode(levels).alias("_i", "k"), names.alias("_names"), "ex")
    examples = F.when(F.col("k") == 0, F.concat(F.lit("Answer the question of task "), F.col("split"), F.lit(".\n\n"))).otherwise(
        F.array_join(F.transform(F.slice(F.col("ex"), 1, F.col("k")), lambda x: x["b"]), "")
    )
    return out.select(
        "split",
        F.element_at(F.col("_names"), F.col("_i") + 1).alias("shot"),
        F.concat(examples, F.lit("|||\nQuestion: {}\nAnswer:\n")).alias("text"),
    )


def write_prompt_corpus(corpus: DataFrame, root: str) -> None:
    """One file per (split, shot): ``root/dir=bench_<split>/file=<shot>/part-*.txt``."""
    (corpus.select(F.concat(F.lit("bench_"), F.col("split")).alias("dir"), F.col("shot").alias("file"), "text")
     .repartition("dir", "file")
     .write.mode("overwrite").partitionBy("dir", "file").text(root))

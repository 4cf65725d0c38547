"""Task catalog (T4/T5) and the task-type lookup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: must equal the benchmark's task table and split -> type map ----
# (split, task_type, capability, task_id, description, question_type, metric, sample_size)
TASKS = [
    ("1_1", "mc", "Understanding", "U1", "Class definition understanding", "MCQ", "Accuracy", 9151),
    ("1_2", "mc", "Understanding", "U2", "Class relation understanding", "MCQ", "Accuracy", 9201),
    ("1_3", "mc", "Understanding", "U3", "Property domain understanding", "MCQ", "Accuracy", 375),
    ("1_4", "mc", "Understanding", "U4", "Instance class understanding", "MCQ", "Accuracy", 2475),
    ("1_5", "mc", "Understanding", "U5", "Instance definition understanding", "MCQ", "Accuracy", 3814),
    ("2_1", "mc", "Reasoning", "R1", "Inferred relation reasoning", "MCQ", "Accuracy", 8208),
    ("2_2", "mc", "Reasoning", "R2", "Constraint reasoning", "MCQ", "Accuracy", 6956),
    ("2_3", "mc", "Reasoning", "R3", "Instance class reasoning", "MCQ", "Accuracy", 3793),
    ("2_4", "mc", "Reasoning", "R4", "SWRL-based logic reasoning", "MCQ", "Accuracy", 6517),
    ("2_5", "bool", "Reasoning", "R5", "Description logic reasoning", "T/FQ", "Accuracy", 2560),
    ("3_1", "open_text", "Learning", "L1", "Class definition generation", "Generation", "ROUGE-L", 2936),
    ("3_2", "open_triple", "Learning", "L2", "Class hierarchy construction", "Generation", "Triple-F1", 952),
    ("3_3", "open_triple", "Learning", "L3", "Property relation construction", "Generation", "Triple-F1", 256),
    ("3_4", "open_triple", "Learning", "L4", "Constraint construction", "Generation", "Triple-F1", 643),
    ("3_5", "open_tuple", "Learning", "L5", "Ontology alignment", "Generation", "Tuple-F1", 1149),
]
DEFAULT_TASK_TYPE = "mc"
SHOT_LEVELS = ["zero_shot", "one_shot", "two_shot", "three_shot", "four_shot"]
GRID_SHOTS = ["zero_shot", "two_shot", "four_shot"]
MAX_TOKENS_CLOSED = 128
MAX_TOKENS_OPEN = 512
# ---- end fixed values ----

CATALOG_DDL = (
    "split string, task_type string, capability string, task_id string, description string, "
    "question_type string, metric string, sample_size bigint"
)
SPLITS = [t[0] for t in TASKS]


def task_catalog(spark: SparkSession) -> DataFrame:
    """The 15-row task dimension.  Its size is fixed by the benchmark, so it is safe to broadcast.
    From Arrow it is a local relation, which no Python worker has to make in every plan."""
    names = [c.split()[0] for c in CATALOG_DDL.split(", ")]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*TASKS))))), CATALOG_DDL)


def catalog_values_sql() -> str:
    """The same dimension as an SQL VALUES list (for oracle queries)."""
    def q(s):
        return "'" + str(s).replace("'", "''") + "'"
    rows = ",\n    ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in t) + ")" for t in TASKS)
    return (
        "(SELECT * FROM (VALUES\n    " + rows + "\n) AS t(split, task_type, capability, task_id, description, "
        "question_type, metric, sample_size))"
    )


def with_task_type(df: DataFrame, catalog: DataFrame, split_col: str = "split") -> DataFrame:
    """Attach ``task_type`` (default ``mc``) and ``is_unknown_split`` by a broadcast left join."""
    dim = F.broadcast(catalog.select(F.col("split").alias("_cat_split"), F.col("task_type").alias("_cat_type")))
    joined = df.join(dim, F.col(split_col) == F.col("_cat_split"), "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.col("_cat_type"), F.lit(DEFAULT_TASK_TYPE)).alias("task_type"),
        F.col("_cat_type").isNull().alias("is_unknown_split"),
    )


def is_mcq_split(split: Column) -> Column:
    """The reference's MCQ test on the split *name*: contains '1_' or '2_' and is not '2_5'."""
    return (split.contains("1_") | split.contains("2_")) & (split != F.lit("2_5"))

"""Checked sources: records that can't be scored are told apart in the pass that stores the rest.

A record is rejected before scoring with the first reason that holds: it can't be parsed, a field that scoring needs is
missing, its prompt path has no shot label, or its generation config is invalid.  ``store_checked`` writes
accepted and rejected records in one job, as partitions of one folder, and counts both with an observation, so
nothing is read twice; a reader of either side prunes the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prompting import config_reject_reason
from ..schemas import ITEMS

MALFORMED = "malformed record"
NO_SHOT = "no shot label in the prompt path"
NEEDED = ("split", "ord", "question", "answer")
_RAW = "_raw"


def read_items_checked(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S1 with a ``reason`` (null: accepted) and, for lines that don't parse, the line in ``record``.

    JSON lines and CSV keep such lines whole; the other formats have no lines and lack fields only."""
    fields = [T.StructField(f.name, f.dataType, True) for f in ITEMS.fields]
    if fmt not in ("json", "csv"):
        items = spark.read.schema(T.StructType(fields)).format(fmt).load(path).withColumn(_RAW, F.lit(None).cast("string"))
    else:
        reader = spark.read.schema(T.StructType([*fields, T.StructField(_RAW, T.StringType())])).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", _RAW)
        if fmt == "csv":
            reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        items = reader.format(fmt).load(path)
    return items.withColumn("reason", item_reject_reason()).withColumnRenamed(_RAW, "record")


def item_reject_reason() -> Column:
    """Reason for a parsed item line: unparsable first, then the first needed field that is missing."""
    reason = F.when(F.col(_RAW).isNotNull(), F.lit(MALFORMED))
    for name in NEEDED:
        reason = reason.when(F.col(name).isNull(), F.lit(f"no {name}"))
    return reason


def label_reject_reason(shot: Column) -> Column:
    """Q10: a run, or a response, whose prompt path gave no shot label."""
    return F.when(shot.isNull(), F.lit(NO_SHOT))


def run_reject_reason(runs: DataFrame, shot: Column) -> Column:
    """P1, then Q10: the first failing check of a run's config, then of its prompt path."""
    return F.coalesce(config_reject_reason(runs), label_reject_reason(shot))


def store_checked(checked: DataFrame, path: str) -> dict[str, int]:
    """Append ``checked`` (with ``reason``) below ``path``; gives the numbers of accepted and rejected rows of this pass."""
    seen = Observation()
    rows = checked.withColumn("accepted", F.col("reason").isNull())
    rows = rows.observe(seen, F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    rows.write.mode("append").partitionBy("accepted").parquet(path)
    return seen.get


def _side(spark: SparkSession, path: str, accepted: bool) -> DataFrame:
    return spark.read.parquet(path).where(F.col("accepted").cast("boolean") == accepted).drop("accepted")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """What scoring reads: the accepted records, without the columns of the check."""
    return _side(spark, path, True).drop("reason", "record")


def read_rejects(spark: SparkSession, path: str, source: str) -> DataFrame:
    """source, reason, record (the line itself if it didn't parse, else the row as JSON)."""
    found = _side(spark, path, False)
    row = F.to_json(F.struct(*[c for c in found.columns if c not in ("reason", "record")]))
    record = F.coalesce("record", row) if "record" in found.columns else row
    return found.select(F.lit(source).alias("source"), "reason", record.alias("record"))

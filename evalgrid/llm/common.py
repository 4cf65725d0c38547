"""Small helpers shared by the training-data operators: scratch tables, folds, bounded memo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.session import store

# The ASCII white space of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and a step that is used
    twice runs once.  The shuffle files of the write are dropped with its end.
    """
    return store(df, name)


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others of ``docs`` inside ``_rest``, where they clash with none that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_rest"))


def take_back(rows: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """``columns``, as they were before ``set_aside``, of rows that came of it."""
    return rows.select(*[F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in columns])


def id_fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0))


def below(share: float, *cols: str) -> Column:
    """A repeatable sample: true for about ``share`` of the distinct values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


class Memo(dict):
    """A memo of ``fn`` that holds ``limit`` entries in each of two generations, so a worker's memory is bounded and what
    is in use stays: when the newer is full it becomes the older, whose entries come back as they are asked for."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn, self.limit, self.older = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older[key] if key in self.older else self.fn(key)
        return value

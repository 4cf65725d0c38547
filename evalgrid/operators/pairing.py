"""Item <-> response pairing (J1), coverage checks (J5) and identifier fallback (P5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import shuffles_dropped, store

CELL = ["model", "split", "shot"]
KEY = ["split", "identifier"]


def resolve_identifier(items: DataFrame) -> DataFrame:
    """P5: identifier -> id -> ``example_{ord}``.  ``ord`` is the item's fixed position in its split."""
    cols = set(items.columns)
    ident = F.col("identifier") if "identifier" in cols else F.lit(None).cast("string")
    alt = F.col("id") if "id" in cols else F.lit(None).cast("string")
    return items.withColumn(
        "identifier", F.coalesce(ident, alt, F.concat(F.lit("example_"), F.col("ord").cast("string")))
    )


def repeated_splits(df: DataFrame, key: list[str], side: str) -> DataFrame:
    """side, split: the splits in which rows share a value of ``key``.  Only the key's columns are read; a frequent key is counted map-side.

    Rows are counted by a 64-bit hash of their key.  That is a third of the memory that the key's strings take, and it can't be
    compressed, so partitions that AQE sizes by their compressed bytes have a bounded number of rows.  Two keys of one hash would only
    bring a split here whose rows are then numbered without need."""
    n = df.groupBy("split", F.xxhash64(*key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return n.where("_n > 1").select(F.lit(side).alias("side"), "split").distinct()


def number_occurrences(df: DataFrame, key: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """``df`` with the number of each row among the rows of its ``key``, from 1, in the order of ``order`` and then of the row's content.

    Rows are dealt by ranges of (key, order), so a key that holds a third of all rows spans many tasks.  Each task numbers
    its sorted rows from 1 for each key; a key that goes on from earlier ranges starts after the rows it has there.  Those counts are
    at most one for each range, which bounds what is broadcast.  The dealt rows are stored, since ranges are drawn from a sample."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    by = [*key, *order, "_content"]
    dealt = df.withColumn("_content", F.xxhash64(*rest) if rest else F.lit(0)).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def run(batches):
        last, n = None, 0
        for batch in batches:
            local = []
            for value in zip(*(batch.column(c).to_pylist() for c in key)):
                n = n + 1 if value == last else 1
                last = value
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "_local"])

    numbered = store(dealt.drop("_content").withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema), "occurrences")
    per_range = numbered.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # only a range's first key can have begun earlier: at most one row for each range
    begun = per_range.withColumn("_before", before).where("_before > 0").select(*[F.col(c).alias("_k_" + c) for c in key], F.col("_part").alias("_k_part"), "_before")
    same = F.col("_part") == F.col("_k_part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col("_k_" + c))
    joined = numbered.join(F.broadcast(begun), same, "left")
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(out))


def _pair_keys(columns: list[str]) -> tuple[list[str], list[str]]:
    by_number = "request_id" in columns
    return (["split", "ord"], [*CELL, "request_id"]) if by_number else (KEY, [*CELL, "identifier"])


def repeated_items(items: DataFrame, columns: list[str]) -> set[tuple[str, str]]:
    """The items' part of ``repeated_sides``, for responses of these ``columns``: items that meet many batches are looked at once."""
    it_key, _ = _pair_keys(columns)
    with shuffles_dropped(items.sparkSession):
        return {(r.side, r.split) for r in repeated_splits(resolve_identifier(items), it_key, "items").collect()}


def repeated_sides(items: DataFrame, responses: DataFrame, of_items: set[tuple[str, str]] | None = None) -> set[tuple[str, str]]:
    """(side, split) of the splits where ``items`` or ``responses`` repeat a key: one job over the keys; its result is bounded by the splits.
    ``of_items``: what ``repeated_items`` found, if it was called before.  Its shuffle files are not kept beside those of the scoring."""
    it_key, resp_key = _pair_keys(responses.columns)
    with shuffles_dropped(responses.sparkSession):
        twice = repeated_splits(responses, resp_key, "responses")
        if of_items is None:
            twice = twice.unionByName(repeated_splits(resolve_identifier(items), it_key, "items"))
        return {(r.side, r.split) for r in twice.collect()} | (of_items or set())


def pair(items: DataFrame, responses: DataFrame, repeated: set[tuple[str, str]] | None = None) -> DataFrame:
    """Each response with its item, at most one of each, so that accuracy never exceeds 1.

    Responses that carry ``request_id`` pair with the item of that position in its split (``ord``), as
    generators number their requests; the first of a repeated number counts.  Otherwise the key is (split, identifier), and the k-th
    response of a cell to an identifier pairs with the k-th item that has it, as outputs listed in the order of their
    items do: items in the order of ``ord``, responses in that of ``response_no`` if there is one (their place in the run's output), and
    by their content if not.  Surplus ones stay without partner and are reported by :func:`coverage` as ``duplicate_key``.

    Keys are looked up first, without texts, in one job when the plan is built; where none repeats, which is the rule, rows join
    as they are and each text is shuffled once.  ``repeated``: what ``repeated_sides`` found, if it was called before."""
    by_number = "request_id" in responses.columns
    it = resolve_identifier(items).drop("id")
    it_key, resp_key = _pair_keys(responses.columns)
    sides = {side for side, _ in (repeated_sides(items, responses) if repeated is None else repeated)}
    order = [c for c in ("response_no",) if c in responses.columns]
    k = "occurrence"
    if sides:
        it = number_occurrences(it, it_key, [] if by_number else ["ord"], k) if "items" in sides else it.withColumn(k, F.lit(1).cast("bigint"))
        responses = (number_occurrences(responses, resp_key, order, k) if "responses" in sides
                     else responses.withColumn(k, F.lit(1).cast("bigint")))
    on = [k] if sides else []
    if by_number:
        numbered = responses.withColumn("ord", F.col("request_id")).drop("identifier", "request_id", *order)
        return numbered.join(_sorted_side(it), ["split", "ord", *on]).drop(k)
    # the hash comes first: sorting compares numbers, not strings that begin alike, and as it can't be compressed, partitions
    # that AQE sizes by their compressed bytes have a bounded number of rows
    given, it = (df.withColumn("_key", F.xxhash64(*KEY)) for df in (responses.drop(*order), it))
    return given.join(_sorted_side(it), ["_key", *KEY, *on]).drop("_key", k)


def _sorted_side(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join: items and responses grow with the input, and files say little about their rows (a narrow column of
    a million keys is a few MB of parquet), so a broadcast chosen from file sizes would bring all of them to the driver."""
    return df.hint("merge")


def coverage(items: DataFrame, responses: DataFrame, cells: DataFrame) -> DataFrame:
    """Items lacking a response in a run cell, responses that match no item, and keys that occur more than once.

    ``cells`` holds the expected (model, split, shot) cells.  They are gathered per split (models x shots of a
    run) and exploded next to each item: items meet one row per split; whether that row is broadcast is left to its measured size."""
    it = resolve_identifier(items).select(*KEY)
    per_split = cells.groupBy("split").agg(F.collect_set(F.struct("model", "shot")).alias("_cells"))
    expected = (it.distinct().join(per_split, "split").withColumn("_c", F.explode("_cells"))
                .select("_c.model", "split", "_c.shot", "identifier"))
    resp = responses.select(*CELL, "identifier")
    missing = expected.join(_sorted_side(resp), CELL + ["identifier"], "left_anti").withColumn("kind", F.lit("missing_response"))
    orphan = resp.join(_sorted_side(it), KEY, "left_anti").withColumn("kind", F.lit("orphan_response"))
    twice = (resp.groupBy(*CELL, "identifier").count().where("count > 1").drop("count")
             .withColumn("kind", F.lit("duplicate_key")))
    item_twice = (it.groupBy(*KEY).count().where("count > 1").select(
        F.lit(None).cast("string").alias("model"), "split", F.lit(None).cast("string").alias("shot"), "identifier",
        F.lit("duplicate_key").alias("kind")))
    columns = ["kind", *CELL, "identifier"]
    return (missing.select(*columns).unionByName(orphan.select(*columns)).unionByName(twice.select(*columns))
            .unionByName(item_twice.select(*columns)))


def token_count(token_ids_col: str = "token_ids"):
    """``len(token_ids) or 1``; a null list counts as empty."""
    return F.greatest(F.coalesce(F.size(F.col(token_ids_col)), F.lit(0)), F.lit(1)).cast("bigint")

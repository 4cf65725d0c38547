"""Pairing by occurrence (J1) where identifiers repeat."""

import random

from pyspark.sql import functions as F

from evalgrid.operators import pairing as P

ITEM = "split string, ord long, identifier string, id string, answer string"
RESPONSE = "model string, split string, shot string, identifier string, text string, response_no long"


def in_order(items, responses):
    """The k-th response to an identifier with its k-th item, by lists."""
    out = []
    for cell in {r[:3] for r in responses}:
        for ident in {i[2] for i in items}:
            mine = sorted((i for i in items if i[0] == cell[1] and i[2] == ident), key=lambda i: i[1])
            given = sorted((r for r in responses if r[:3] == cell and r[3] == ident), key=lambda r: r[5])
            out += [(*cell, ident, i[1], r[4]) for i, r in zip(mine, given)]
    return sorted(out)


def test_kth_response_meets_kth_item(spark):
    rng = random.Random(2)
    items = [(rng.choice(["1_1", "1_2"]), n, f"q{rng.randrange(40)}" if n % 3 else "hot", None, "A") for n in range(400)]
    responses = [(f"m{m}", i[0], "zero_shot", i[2], f"{m} {i[1]}", i[1]) for i in items for m in range(2) if rng.random() < 0.9]
    responses += [("m0", "1_1", "zero_shot", "hot", "surplus", 10_000 + n) for n in range(50)]
    rng.shuffle(responses)
    got = P.pair(spark.createDataFrame(items, ITEM), spark.createDataFrame(responses, RESPONSE))
    assert sorted(tuple(r) for r in got.select("model", "split", "shot", "identifier", "ord", "text").collect()) == in_order(items, responses)


def test_a_frequent_identifier_spans_tasks(spark, monkeypatch):
    stored, store = [], P.store
    monkeypatch.setattr(P, "store", lambda df, name: stored.append(store(df, name)) or stored[0])
    rows = spark.range(30_000).selectExpr("'s' AS split", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('q', id) END AS identifier", "id AS ord")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this little data would be one range
    try:
        numbered = P.number_occurrences(rows, ["split", "identifier"], ["ord"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = numbered.where("identifier = 'hot'")
    assert [r.occurrence for r in hot.orderBy("ord").collect()] == list(range(1, 10_001))
    sizes = [r["count"] for r in stored[0].where("identifier = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 10_000
    assert numbered.where("identifier <> 'hot'").agg(F.max("occurrence")).first()[0] == 1


def test_equal_rows_and_nulls(spark):
    responses = [("m", "1_1", "zero_shot", "x", "A", None)] * 3 + [("m", "1_1", "zero_shot", None, "A", None)] * 2
    items = [("1_1", 0, "x", None, "A"), ("1_1", 1, "x", None, "B")]
    got = P.pair(spark.createDataFrame(items, ITEM), spark.createDataFrame(responses, RESPONSE))
    assert sorted(r.ord for r in got.collect()) == [0, 1]
    none = spark.createDataFrame([], RESPONSE)
    assert P.pair(spark.createDataFrame(items, ITEM), none).count() == 0
    assert P.pair(spark.createDataFrame([], ITEM), spark.createDataFrame(responses, RESPONSE)).count() == 0


def test_unique_keys_need_no_numbering(spark):
    items = spark.createDataFrame([("1_1", n, f"q{n}", None, "A") for n in range(5)], ITEM)
    responses = spark.createDataFrame([("m", "1_1", "zero_shot", f"q{n}", "A", n) for n in range(5)], RESPONSE)
    plan = P.pair(items, responses)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" not in plan


def test_items_are_never_broadcast(spark):
    """Small files may hold many rows: neither items nor responses go through the driver, whatever the threshold."""
    items = spark.createDataFrame([("1_1", n, f"q{n}", None, "A") for n in range(5)], ITEM)
    responses = spark.createDataFrame([("m", "1_1", "zero_shot", f"q{n}", "A", n) for n in range(4)], RESPONSE)
    numbered = responses.withColumn("request_id", F.col("response_no"))
    cells = responses.select("model", "split", "shot").distinct()
    kept = [spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        for joined, rows, broadcasts in ((P.pair(items, responses), 4, 0), (P.pair(items, numbered), 4, 0), (P.coverage(items, responses, cells), 1, 1)):
            assert len(joined.collect()) == rows
            plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("SortMergeJoin") >= 1 and plan.count("BroadcastHashJoin") <= broadcasts  # one row per split may be
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", kept[1])

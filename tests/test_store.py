import time

from evalgrid.llm.common import cut
from evalgrid.operators.pairing import repeated_items, repeated_sides
from evalgrid.session import _CLEANUP_KEY, store


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_stored_steps_leave_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage."""
    before, set_before = _shuffle_files(spark), spark.conf.get(_CLEANUP_KEY, None)
    for keep in (store, cut):
        rows = keep(spark.range(2000).selectExpr("id % 7 AS k", "id").groupBy("k").agg({"id": "sum"}).repartition(5), "left")
        until = time.time() + 20
        while (left := _shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.2)
        assert not left and rows.count() == 7
        before = _shuffle_files(spark)
    assert spark.conf.get(_CLEANUP_KEY, None) == set_before


def test_a_failed_store_leaves_the_setting(spark):
    set_before = spark.conf.get(_CLEANUP_KEY, None)
    try:
        store(spark.range(1).selectExpr("raise_error('no') AS x"), "failed")
    except Exception:  # noqa: BLE001 - Spark's own
        assert spark.conf.get(_CLEANUP_KEY, None) == set_before
    else:
        raise AssertionError("the write should have failed")


def test_the_look_for_repeated_keys_leaves_no_shuffle_files(spark):
    """They lay beside those of the scoring."""
    items = spark.range(300).selectExpr("'1_1' AS split", "id AS ord", "concat('i', id % 299) AS identifier", "CAST(NULL AS STRING) AS id")
    responses = spark.range(600).selectExpr("'m' AS model", "'1_1' AS split", "'zero_shot' AS shot", "concat('i', id) AS identifier")
    before = _shuffle_files(spark)
    assert repeated_sides(items, responses) == {("items", "1_1")} == repeated_items(items, responses.columns)
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left

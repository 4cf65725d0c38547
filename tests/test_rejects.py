import json

import pytest
from pyspark.sql import functions as F

from evalgrid.functions.text import shot_label
from evalgrid.operators.prompting import BAD_TOP_P
from evalgrid.session import scratch_path
from evalgrid.sources import rejects as rj

GOOD = {"split": "1_1", "ord": 0, "identifier": "a", "question": "q", "answer": "A"}


def write_lines(spark, lines):
    path = scratch_path(spark, "reject-lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_item_lines(spark):
    lines = [json.dumps(GOOD), '{"split": "1_1", "ord": 1, "question": "cut', "not json at all", json.dumps(GOOD | {"ord": 3, "answer": None}),
             json.dumps({k: v for k, v in GOOD.items() if k != "question"} | {"ord": 4}), json.dumps(GOOD | {"ord": "x"}), json.dumps(GOOD | {"ord": 6})]
    checked = rj.read_items_checked(spark, write_lines(spark, lines))
    path = scratch_path(spark, "reject-store")
    assert rj.store_checked(checked, path) == {"accepted": 2, "rejected": 5}
    assert sorted(r.ord for r in rj.read_accepted(spark, path).collect()) == [0, 6]
    assert set(rj.read_accepted(spark, path).columns) == {"split", "ord", "identifier", "id", "question", "options", "answer"}
    rejects = rj.read_rejects(spark, path, "items").collect()
    assert {r.source for r in rejects} == {"items"}
    by_reason = {}
    for r in rejects:
        by_reason.setdefault(r.reason, []).append(r.record)
    assert sorted(by_reason[rj.MALFORMED]) == sorted([lines[1], lines[2], lines[5]])
    assert json.loads(by_reason["no answer"][0])["ord"] == 3 and json.loads(by_reason["no question"][0])["ord"] == 4
    # a second drop is appended, and counted alone
    assert rj.store_checked(rj.read_items_checked(spark, write_lines(spark, lines[:2])), path) == {"accepted": 1, "rejected": 1}
    assert rj.read_accepted(spark, path).count() == 3 and rj.read_rejects(spark, path, "items").count() == 6


def test_csv_lines(spark):
    path = scratch_path(spark, "reject-csv")
    lines = ["split,ord,identifier,id,question,options,answer", "1_1,0,a,,q,,A", "1_1,x,b,,q,,A", "1_1,2,c,,q,,"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = {r.identifier: r.reason for r in rj.read_items_checked(spark, path, "csv").collect()}
    assert got == {"a": None, "b": rj.MALFORMED, "c": "no answer"}


def test_runs(spark):
    runs = spark.createDataFrame(
        [(0, "p/two_shot.txt", 1, 1, 0.0, 1.0), (1, "p/few.txt", 1, 1, 0.0, 1.0), (2, "p/few.txt", 1, 1, 0.0, 1.5), (3, None, 1, 1, 0.0, 1.0)],
        "run int, prompt_path string, max_batched_tokens int, max_tokens int, temperature double, top_p double")
    got = dict(runs.select("run", rj.run_reject_reason(runs, shot_label(F.col("prompt_path")))).collect())
    assert got == {0: None, 1: rj.NO_SHOT, 2: BAD_TOP_P, 3: rj.NO_SHOT}


@pytest.mark.parametrize("rows", [[], [("a", None)]])
def test_one_sided_tables(spark, rows):
    path = scratch_path(spark, "reject-one-side")
    counts = rj.store_checked(spark.createDataFrame(rows, "x string, reason string"), path)
    assert counts == {"accepted": len(rows), "rejected": 0}
    if rows:
        assert rj.read_rejects(spark, path, "x").count() == 0 and rj.read_accepted(spark, path).count() == 1

"""Items that meet several runs or batches are made, stored and parsed once; drops of the stream are many files."""

import os

import pytest

from evalgrid.plans import evaluate, partials, registry
from evalgrid.plans import fixtures as fx
from evalgrid.session import store
from evalgrid.streaming import incremental


@pytest.mark.parametrize("mode", ["reference", "corrected"])
def test_gold_parsed_before(spark, small_sf, mode):
    items = fx.mc_items(spark, small_sf).unionByName(fx.triple_items(spark, small_sf)).unionByName(fx.tuple_items(spark, small_sf))
    responses = fx.mc_responses(spark, small_sf).unionByName(fx.triple_responses(spark, small_sf)).unionByName(fx.tuple_responses(spark, small_sf))
    gold = store(evaluate.with_gold(spark, items, mode), "t_gold")

    def rows(i):
        return sorted(map(repr, evaluate.extract(spark, i, responses, mode, repeated=set()).collect()))
    assert rows(gold) == rows(items)
    plan = evaluate.extract(spark, gold, responses, mode, (True,), set())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the predictions' parser


def _scanned(items):
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    return "ref_tuples" in items.columns and "Aggregate" not in plan and "Union" not in plan


def test_stream_stores_items_and_drops_are_many_files(spark, small_sf, monkeypatch):
    seen = []

    def add_run(spark, items, batch, path, run, *args):
        seen.append(_scanned(items))
        return partials.add_run(spark, items, batch, path, run, *args)
    drops, score = [], incremental.score_stream

    def score_stream(spark, items, drop, *args, **kw):
        drops.append(len([f for f in os.listdir(drop.removeprefix("file:")) if f.endswith(".parquet")]))
        return score(spark, items, drop, *args, **kw)
    monkeypatch.setattr(incremental, "add_run", add_run)
    monkeypatch.setattr(incremental, "score_stream", score_stream)
    out = registry.QUERIES["s7_summary_stream"](spark, small_sf)
    assert out.where("n_appends = 1").count() == out.count() > 0
    assert seen == [True] * 3
    assert len(drops) == 3 and all(more > n + 1 for n, more in zip([0, *drops], drops))  # one file a drop before


def test_stored_grid_reads_stored_items_and_looks_once(spark, small_sf, monkeypatch):
    from evalgrid.operators import pairing
    looks, seen = [], []
    look, add_run = pairing.repeated_sides, partials.add_run
    counted = lambda *a: looks.append(1) or look(*a)
    monkeypatch.setattr(pairing, "repeated_sides", counted)
    monkeypatch.setattr(evaluate, "repeated_sides", counted)
    monkeypatch.setattr(partials, "add_run", lambda spark, items, *a, **kw: seen.append(_scanned(items)) or add_run(spark, items, *a, **kw))
    monkeypatch.setattr(registry, "_GRID", {})
    registry._stored_grid(spark, small_sf)
    assert seen == [True, True] and len(looks) == 1

"""Stored sums (M11, S7, RP1-RP4): merging, replays, split cells, and digits that no order changes."""

import pytest
from pyspark.sql import functions as F

from evalgrid.plans import evaluate, partials, registry
from evalgrid.plans import fixtures as fx
from evalgrid.schemas import METRICS
from evalgrid.session import scratch_path
from evalgrid.sources.sinks import summary_text


def rows(df):
    return sorted(map(tuple, df.select("model", "split", "shot", *METRICS).collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark, small_sf):
    items = fx.mc_items(spark, small_sf).unionByName(fx.triple_items(spark, small_sf)).unionByName(fx.conversation_items(spark, small_sf))
    responses = (fx.mc_responses(spark, small_sf).unionByName(fx.triple_responses(spark, small_sf))
                 .unionByName(fx.conversation_responses(spark, small_sf)))
    path = scratch_path(spark, "t_inputs")
    items.write.parquet(path + "/items")
    responses.write.parquet(path + "/responses")
    return spark.read.parquet(path + "/items"), spark.read.parquet(path + "/responses")


def test_cells_split_over_runs_and_replays(spark, small):
    items, responses = small
    path = scratch_path(spark, "t_sums")
    partials.write_sizes(items, path)
    part = F.pmod(F.xxhash64("model", "identifier", "shot"), F.lit(3))
    for n in (0, 1, 2, 1):  # the second run again
        partials.add_run(spark, items, responses.where(part == n), path, f"run-{n}", stem=False)
    assert rows(partials.stored_summary(spark, path)) == rows(evaluate.summarize_run(spark, items, responses, stem=False))
    assert partials.run_names(spark, path).count() == 3
    plan = partials.stored_summary(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("FileScan") == 2  # sums and sizes, no responses


def test_stream_of_split_cells(spark, small):
    from evalgrid.streaming.incremental import compact, score_stream
    items, responses = small
    drop, sums, ckpt, folded = (scratch_path(spark, n) for n in ("t_drop", "t_stream", "t_ckpt", "t_folded"))
    responses.where("split = '1_1' OR split = '3_1'").repartition(2).write.parquet(drop)
    score_stream(spark, items, drop, sums, ckpt, stem=False, files_per_batch=1)
    want = rows(evaluate.summarize_run(spark, items, responses.where("split = '1_1' OR split = '3_1'"), stem=False))
    assert rows(partials.stored_summary(spark, sums)) == want and partials.run_names(spark, sums).count() == 2
    responses.where("split = '1_2'").coalesce(1).write.mode("append").parquet(drop)  # a later drop
    score_stream(spark, items, drop, sums, ckpt, stem=False)
    both = rows(evaluate.summarize_run(spark, items, responses.where("split IN ('1_1', '1_2', '3_1')"), stem=False))
    assert rows(partials.stored_summary(spark, sums)) == both
    compact(spark, sums, folded)
    assert rows(partials.stored_summary(spark, folded)) == both


def test_text_of_means_does_not_depend_on_partitions(spark):
    scores = spark.range(20_000).select(
        F.lit("m").alias("model"), F.lit("3_1").alias("split"), F.lit("zero_shot").alias("shot"), F.lit("open_text").alias("task_type"),
        F.lit(None).cast("boolean").alias("match"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")],
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10 ** 9)) / 999_999_999.0).alias(c) for c in ("bleu", "rouge1", "rouge2", "rougeL")])
    sizes = spark.createDataFrame([("3_1", 20_000)], "split string, n_items long")
    got = {str(evaluate.summary_of_counts(evaluate.cell_counts(scores.repartition(n, "bleu")), sizes, "d", "p").first().asDict()) for n in (1, 7, 211)}
    assert len(got) == 1


def test_mean_just_below_a_tie_is_not_rounded_twice(spark):
    """A mean of 0.49184978877 is 0.4918; by way of six places it would be 0.4919."""
    one = spark.createDataFrame([("d", "3_1", "m", "p", "open_text", 0.4918499 - 1e-7)], "dataset string, split string, model string, prompt_path string, task_type string, x double")
    text = summary_text(one.select("*", *[F.col("x").alias(c) for c in METRICS])).first()
    assert text.rougeL == "0.4918" == f"{0.4918499 - 1e-7:.4f}"
    assert "round(" not in registry.ORACLE["s7_summary"].split("printf")[0]


def test_reports_read_stored_sums(spark, small_sf):
    for name in ("rp1_headline", "rp2_capability_rollup", "rp3_shot_pivot", "rp4_leaderboard"):
        plan = registry.QUERIES[name](spark, small_sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "documents" not in plan and "lineitem" not in plan

"""Sources and sinks: split selection, prompt files, detail/summary round trips, run grid."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from evalgrid.session import scratch_path
from evalgrid.sources import items as si
from evalgrid.sources import prompts as sp
from evalgrid.sources import sinks as sk

ITEMS = [("1_1", 0, "a", None, "q0", "A. x\nB. y", "A"), ("1_2", 1, "b", None, "q1", None, "B"),
         ("2_1", 2, None, "c", "q2", None, "C"), ("11_2", 3, None, None, "q3", None, "D")]


@pytest.fixture()
def items(spark):
    from evalgrid.schemas import ITEMS as SCHEMA
    return spark.createDataFrame(ITEMS, SCHEMA)


def test_select_split_reference_last_substring_wins(items):
    got = {r.split for r in si.select_split(items, "1_").collect()}
    assert got == {"1_2"}  # 1_1, 1_2, 11_2 contain "1_"; the last in name order is 1_2
    assert {r.split for r in si.select_split(items, "1_1", mode="corrected").collect()} == {"1_1"}


def test_select_split_missing_raises(items):
    with pytest.raises(Exception, match="not found"):
        si.select_split(items, "9_9", mode="corrected").collect()


def test_identifier_fallback(items):
    from evalgrid.operators.pairing import resolve_identifier
    assert [r.identifier for r in resolve_identifier(items).orderBy("ord").collect()] == ["a", "b", "c", "example_3"]


def test_prompt_parse_rejects(spark):
    texts = ["ex\n|||\nQuestion: {}\nAnswer:", "no separator", "a|||b|||c", "   |||tmpl", "ex|||   "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.valid, r.n_parts) for r in sp.parse_prompts(df).collect()]
    assert got == [(True, 2), (False, 1), (False, 3), (False, 2), (False, 2)]


def test_prompt_corpus_scan_reference_layout(spark):
    root = tempfile.mkdtemp(prefix="evalgrid-prompts-")
    for split, shot, body in [("1_1", "two_shot", "E1\n\n|||\nQuestion: {}\nAnswer:\n"), ("3_2", "zero_shot", "bad")]:
        os.makedirs(f"{root}/bench_{split}", exist_ok=True)
        with open(f"{root}/bench_{split}/{shot}.txt", "w") as f:
            f.write(body)
    rows = {(r.split, r.shot): r for r in sp.read_prompt_corpus(spark, root).collect()}
    assert rows[("1_1", "two_shot")].valid and rows[("1_1", "two_shot")].template == "\nQuestion: {}\nAnswer:"
    assert not rows[("3_2", "zero_shot")].valid


def test_prompt_assembly_braces_inert(spark):
    from evalgrid.operators.prompting import assemble_prompt, question_block
    df = spark.createDataFrame([("1_1", "  What is {x}? ", "A. a\n\nB. b\n")], "split string, q string, o string")
    block = question_block(F.col("split"), F.col("q"), F.col("o"))
    p = df.select(assemble_prompt(F.lit("EX"), F.lit("\nQuestion: {}\nAnswer:"), block)).first()[0]
    assert p == "EX\nQuestion: What is {x}?\nA. a\nB. b\nAnswer:"


def test_detail_and_summary_round_trip(spark, small_sf):
    from evalgrid.plans import fixtures as fx
    from evalgrid.plans.evaluate import extract, summarize
    items = fx.mc_items(spark, small_sf)
    e = extract(spark, items, fx.mc_responses(spark, small_sf))
    path = scratch_path(spark, "t_details")
    cols = ["identifier", "question", "options", "response", "answer", "pred_text", "pred_tuples",
            "log_probability", "token_count", "match", "ord", "model", "split", "shot"]
    sk.write_details(e.select(*cols), path)
    back = sk.read_details(spark, path)
    assert back.count() == e.count()
    local = path.split(":", 1)[1] if path.startswith("file:") else path
    assert any(d.startswith("model=") for d in os.listdir(local))
    s = summarize(spark, e, items)
    spath = scratch_path(spark, "t_summary")
    sk.append_summary(s, spath)
    sk.append_summary(s, spath)
    r = sk.read_summary(spark, spath)
    assert r.count() == 2 * s.count()
    assert r.where("accuracy IS NOT NULL AND accuracy RLIKE '^[0-9]\\\\.[0-9]{4}$'").count() == r.count()


def test_run_grid_and_missing_cells(spark):
    from evalgrid.plans.grid import run_grid
    from evalgrid.plans.report import latest_runs, missing_cells
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    g = run_grid(models)
    assert g.count() == 2 * 15 * 3
    assert {r.max_tokens for r in g.where("split = '3_1'").collect()} == {512}
    runs = spark.createDataFrame([("m1", "1_1", "zero_shot", 1, 0.5), ("m1", "1_1", "zero_shot", 2, 0.7)],
                                 "model string, split string, shot string, timestamp int, accuracy double")
    last = latest_runs(runs).first()
    assert last.accuracy == 0.7 and last.n_runs == 2
    assert missing_cells(runs).count() == 15 * 3 - 1


def test_items_csv_round_trip(spark, items):
    path = scratch_path(spark, "t_items_csv")
    si.write_items(items, path, fmt="csv")
    back = si.read_items(spark, path, fmt="csv")
    got = sorted((r.split, r.ord, r.options) for r in back.collect())
    assert got == sorted((r[0], r[1], r[5]) for r in ITEMS)


def test_items_in_order_within_files(spark, small_sf):
    from evalgrid.plans import fixtures as fx
    from evalgrid.plans.evaluate import extract
    e = extract(spark, fx.mc_items(spark, small_sf), fx.mc_responses(spark, small_sf))
    cols = ["identifier", "question", "options", "response", "answer", "pred_text", "pred_tuples",
            "log_probability", "token_count", "match", "ord", "model", "split", "shot"]
    path = scratch_path(spark, "t_order")
    sk.write_details(e.select(*cols), path)
    read = sk.read_details(spark, path).select("ord", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
    files = {}
    for r in read.collect():
        files.setdefault(r.f, []).append((r["at"], r["ord"]))
    assert files and all([o for _, o in sorted(v)] == sorted(o for _, o in v) for v in files.values())


def test_replayed_batch_adds_no_row(spark, small_sf):
    from evalgrid.plans import fixtures as fx
    from evalgrid.plans.evaluate import extract, summarize
    items = fx.mc_items(spark, small_sf)
    s = summarize(spark, extract(spark, items, fx.mc_responses(spark, small_sf)), items)
    path = scratch_path(spark, "t_replay")
    for _ in range(2):
        sk.write_summary_batch(s, path, 7)
    assert sk.read_summary(spark, path).count() == s.count()
    assert sk.read_summary(spark, path).columns[:6] == ["timestamp", "dataset", "split", "model", "prompt_path", "task_type"]


def test_checkpoint_folder_must_be_shared():
    from evalgrid.session import checkpoint_folder
    assert checkpoint_folder("hdfs://x", "yarn") == "hdfs://x" and checkpoint_folder(None, "local[2]")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(None, master)


def test_repeated_keys_pair_in_order(spark):
    from evalgrid.operators import pairing, score_exact
    from evalgrid.plans.evaluate import extract
    items = spark.createDataFrame([("1_1", i, k, None, "?", None, "A") for i, k in ((0, "x"), (1, "x"), (2, "y"))], si.ITEMS)
    rows = [("m", "1_1", "zero_shot", k, "A", None, None) for k in ("x", "x", "y", "z")]
    from evalgrid.schemas import REQUEST_RESPONSES, RESPONSES
    resp = spark.createDataFrame(rows, RESPONSES)
    acc = score_exact.accuracy(extract(spark, items, resp), items).first()
    assert (acc.correct, acc.n_items) == (3, 3) and acc.accuracy == 1  # each of two items of one identifier has its own response
    kinds = [r.kind for r in pairing.coverage(items, resp, resp.select("model", "split", "shot").distinct()).collect()]
    assert sorted(kinds) == ["duplicate_key", "duplicate_key", "orphan_response"]
    numbered = spark.createDataFrame([(i, *r) for i, r in ((0, rows[0]), (1, rows[1]), (1, rows[1]), (2, rows[2]))], REQUEST_RESPONSES)
    assert score_exact.accuracy(extract(spark, items, numbered), items).first().accuracy == 1.0


def test_compressed_details_read_back(spark, tmp_path):
    from evalgrid.schemas import DETAILS
    from evalgrid.sources.sinks import read_details, write_details
    rows = spark.range(400).selectExpr(*[f"CAST({'id' if f.name == 'ord' else repr(chr(120)) if f.name in ('model', 'split', 'shot', 'question') else 'NULL'} "
                                         f"AS {f.dataType.simpleString()}) AS {f.name}" for f in DETAILS.fields if f.name != "model_safe"])
    sizes = {}
    for codec in ("none", "gzip"):
        write_details(rows, str(tmp_path / codec), compression=codec)
        files = [f for f in (tmp_path / codec).rglob("part-*") if not f.name.endswith(".crc")]
        assert all(f.name.endswith(".gz") == (codec == "gzip") for f in files)
        sizes[codec] = sum(f.stat().st_size for f in files)
        assert sorted(r.ord for r in read_details(spark, str(tmp_path / codec)).collect()) == list(range(400))
    assert 4 * sizes["gzip"] < sizes["none"]

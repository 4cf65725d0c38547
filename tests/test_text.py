"""Whitespace stripping, tokenisers, shot labels, model names."""

from pyspark.sql import functions as F

from evalgrid.functions import text as tx


def test_py_strip_matches_python(spark):
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    samples = [ws + "a b" + ws, "\x1c\tx\n", "  ", "", "mid dle", "　y "]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r[0] for r in df.select(tx.py_strip(F.col("x"))).collect()]
    assert got == [s.strip() for s in samples]


def test_shot_label_and_model_safe(spark):
    paths = ["./prompt/bench_1_1/two_shot.txt", "x/Four_Shot.TXT", "zero_shot/prompt.txt", "fewshot.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(tx.shot_label(F.col("p"))).collect()] == ["two", "four", None, None]
    m = spark.createDataFrame([("Qwen/Qwen2.5-7B",)], "m string").select(tx.model_safe(F.col("m"))).first()[0]
    assert m == "Qwen_Qwen2.5_7B"


def test_tokenisers(spark):
    df = spark.createDataFrame([("Don't stop, Émile! x_1",)], "x string")
    b, r = df.select(tx.bleu_tokens(F.col("x")), tx.rouge_tokens(F.col("x"))).first()
    assert list(b) == ["don", "'", "t", "stop", ",", "émile", "!", "x_1"]
    assert list(r) == ["don", "t", "stop", "mile", "x", "1"]


def test_fmt4_equals_python(spark):
    import random
    rnd = random.Random(1)
    values = [0.03125, 0.09375, 0.15625, 0.21875, 0.12335, 0.12345, 0.00005, 0.99995, 0.0, 1.0, 2.5, 100.0, -0.03125, -0.2, 1e-9]
    values += [k / 32 for k in range(65)] + [rnd.randint(0, n) / n for n in (rnd.randint(1, 5000) for _ in range(3000))]
    values += [rnd.randint(0, 99999) / 100000 for _ in range(3000)] + [rnd.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r[0] for r in df.select(tx.fmt4(F.col("x"))).collect()]
    assert got == ["%.4f" % v for v in values] + [None]


def test_timestamp_text(spark):
    df = spark.sql("select timestamp '2024-03-05 06:07:08.012345' as t")
    assert df.select(tx.iso_timestamp(F.col("t"))).first()[0] == "2024-03-05T06:07:08.012345"

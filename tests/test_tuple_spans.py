import random

from pyspark.sql import functions as F

from evalgrid.catalog import CATALOG_DDL, TASKS, task_catalog
from evalgrid.functions.text import WS_CLASS, py_strip
from evalgrid.operators import extract as ex

def by_patterns(text, mode):
    """E5 by its patterns."""
    s = F.translate(text, "[{]}", "(())")
    if mode == "reference":
        spans = F.transform(F.regexp_extract_all(F.btrim(s, F.lit("()")), F.lit(r"\(([^)]+)\)"), 1), py_strip)
    else:
        spans = F.regexp_extract_all(s, F.lit(r"\(([^()]*)\)"), 1)

    def parts(span):
        kept = F.ltrim(F.regexp_replace(span, r"(?:\A|,)" + WS_CLASS + r"*(?=,|\z)", ""), F.lit(","))
        return F.split(F.regexp_replace(F.btrim(kept, F.lit(" '\"")), r"[ '\"]*,[ '\"]*", ","), ",", -1)
    return F.filter(F.transform(spans, parts), lambda t: F.size(t) >= 2)


def test_brackets_are_replaced_without_a_map(spark):
    """Each character of each answer was looked up in a map."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("a b,,()()['\" \t\x1c é]") for _ in range(rnd.randint(0, 24))) for _ in range(6000)]
    texts += ["".join(rnd.choice(["(a, b, c)", "(d,e)", " ", "\n", "(", ")", ",", ", ", "('x', \"y\")", "[q, r]"]) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    texts += ["(" + " " * 20000 + "x, y" + " " * 20000 + "z)", "", "()", "(,)", "(a,)(,b)(, c, d ,)", "(a, b)", "( ,b, c)(d,\t,e)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for mode in ("reference", "corrected"):
        both = df.select("t", ex.regex_tuples(F.col("t"), mode).alias("x"), by_patterns(F.col("t"), mode).alias("y"))
        assert both.where("size(x) > 1").count() > 100
        plan = both.select("x")._jdf.queryExecution().optimizedPlan().toString()
        assert "translate" not in plan
        assert both.where("not (x <=> y)").limit(3).collect() == []


def test_only_rows_that_may_be_literals_are_looked_at(spark):
    """Rows that are none cost a list each in the Python step."""
    texts = ["('a', 'b')", None, "(a, b)", "[(1, 2), (3, 4)]", "('a', ", "{'x', 'y'}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = {r.i: r.x for r in df.select("i", ex._literal_tuples_udf("t").alias("x")).collect()}
    assert found == {0: [["a", "b"]], 1: None, 2: [], 3: [["1", "2"], ["3", "4"]], 4: [], 5: []}
    lines = spark.createDataFrame([("('a', 'b')\n('c', 'd')\nx",), (None,), ("1\n2",)], "t string").coalesce(1)
    assert [r.x for r in lines.select(ex._literal_tuples_lines_udf("t").alias("x")).collect()] == [[["a", "b"], ["c", "d"]], None, []]
    assert df.select(ex.literal_tuples(F.col("t")).alias("x")).where("x is null").count() == 0


def test_catalog_is_a_local_relation(spark):
    """A Python worker made it in every plan."""
    c = task_catalog(spark)
    assert "LocalRelation" in c._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in c.collect()] == TASKS
    assert c.schema == spark.createDataFrame([], CATALOG_DDL).schema

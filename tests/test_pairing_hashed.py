"""J1 by a hash of its key: which splits repeat a key, and plans whose sorts and counts go by a number."""

import random
import re

from pyspark.sql import functions as F

from evalgrid.operators import pairing as P

ITEM = "split string, ord long, identifier string, id string, answer string"
RESPONSE = "model string, split string, shot string, identifier string, text string"


def test_repeated_sides_as_counted(spark):
    rng = random.Random(5)
    items = [(rng.choice(["1_1", "1_2", "2_5", None]), n, rng.choice([None, f"q{n}", f"q{rng.randrange(300)}"]), None, "A") for n in range(60)]
    responses = [(f"m{rng.randrange(2)}", i[0], rng.choice(["zero_shot", None]), i[2], "x") for i in items for _ in range(2) if rng.random() < 0.4]
    i, r = spark.createDataFrame(items, ITEM), spark.createDataFrame(responses, RESPONSE)

    def counted(rows, key, side):
        return {(side, k[1] if side == "responses" else k[0]) for k in map(key, rows) if [key(x) for x in rows].count(k) > 1}
    want = (counted(items, lambda x: (x[0], x[2] or f"example_{x[1]}"), "items") | counted(responses, lambda x: x[:4], "responses"))
    got = P.repeated_sides(i, r)
    assert got == want and P.repeated_sides(i, r, P.repeated_items(i, r.columns)) == want
    assert {side for side, _ in want} == {"items", "responses"}


def test_counts_and_sorts_go_by_a_number(spark):
    ids = spark.range(100).selectExpr("'1_1' AS split", "id AS ord", "concat('q', id) AS identifier", "CAST(NULL AS string) AS id", "'A' AS answer")
    given = ids.selectExpr("'m' AS model", "split", "'zero_shot' AS shot", "identifier", "'A' AS text")
    look = P.repeated_splits(given, ["model", "split", "shot", "identifier"], "responses")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*identifier", look) and "hashpartitioning(" in look
    paired = P.pair(ids, given, set())
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[_key#", plan)) == 2 and "_key" not in paired.columns
    assert paired.count() == 100 and paired.select(F.countDistinct("ord")).first()[0] == 100

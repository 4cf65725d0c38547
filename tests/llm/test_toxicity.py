import random

from pyspark.sql import functions as F

from evalgrid.llm import toxicity as T
from evalgrid.llm.common import id_fold, read_table


def best_segments(scores):
    """Maximal scoring segments by definition: the best segment first, then left and right of it."""
    def best(lo, hi):
        found = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if found[0] <= 1e-9:
            return []
        a, b = found[3], found[4]
        return best(lo, a) + [(a, b - 1, found[0])] + best(b, hi)
    return best(0, len(scores))


def test_scan_finds_maximal_segments():
    rnd = random.Random(1)
    for _ in range(200):
        gains = [rnd.choice([0, 0, 0, 1.7, 2.9, 0.6]) for _ in range(rnd.randint(0, 14))]
        at = [i for i, g in enumerate(gains) if g]
        got = T.maximal_segments(at, [gains[i] for i in at], -0.75)
        want = best_segments([g or -0.75 for g in gains])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = T.score(docs.select("doc_id", "text"), T.fit(docs, labels)).join(labels, "doc_id").where(id_fold("doc_id", 5) == 0)
    rows = scored.select("score", "toxic").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.95
    assert sum(s >= 0.5 for s in clean) <= 0.01 * len(clean)


def test_odd_rows_and_empty_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).drop("score")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.score(docs, T.fit(docs, labels)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score < 0.5 and r.passages == [] for r in out)
    assert T.score(docs.where(F.lit(False)), T.ToxicityModel()).count() == 0

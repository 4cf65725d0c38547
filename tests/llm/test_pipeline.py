import corpus_pipeline as C
from pyspark.sql import functions as F

from evalgrid.llm import lines, nearcopies, queries
from evalgrid.llm.common import cut, read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = read_table(spark, SF, "documents")
    labels = read_table(spark, SF, "labels")
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        assert docs.columns == first.columns and docs.schema == first.schema
        if name == "toxicity":
            clean = labels.where("toxic = 0").join(before, "doc_id", "left_semi")
            assert clean.join(docs, "doc_id", "left_anti").count() <= 0.02 * clean.count() + 1
        if name == "line_dedup":
            seen = docs.select(F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= lines.MIN_CHARS)
            assert docs.count() == before.count() and seen.count() == seen.distinct().count()
            assert docs.where("n_chars != length(text)").count() == 0
        if name == "near_dedup":
            again = nearcopies.near_copies(docs).where("node is not null")
            assert again.count() == again.select("class_id").distinct().count()
            assert before.count() >= docs.count() > 0
        if name == "mixing":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    totals = {}
    for p in pieces:
        totals[p.doc_id] = totals.get(p.doc_id, 0) + p.length
    copies = {r[0]: r[1] for r in docs.groupBy("doc_id").count().collect()}
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(totals[d] == size[d] * copies[d] for d in copies) and C.run(spark, SF).count() == len(pieces)


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}


def test_odd_rows(spark, odd_rows):
    schema = read_table(spark, SF, "documents").schema
    rows = [(i, t, None, None, None) for i, t in odd_rows]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in C.STAGES:
        docs = cut(stage(spark, docs, SF), "odd")
    assert docs.count() > 0
    empty = spark.createDataFrame([], schema)
    for _, stage in C.STAGES:
        empty = cut(stage(spark, empty, SF), "none")
    assert empty.count() == 0


def test_clashing_columns(spark):
    """Extra columns named as the operators' own go through every stage unchanged."""
    names = ["score", "evidence", "passages", "n_lines", "n_removed", "tokens", "posterior", "rate", "copies", "node", "class_id", "_rest", "_copy", "a.b"]
    docs = read_table(spark, SF, "documents").where("doc_id % 5 = 0")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names])
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), f"clash-{name}")
        assert docs.columns == columns
        assert docs.where(" or ".join(f"`{c}` is null or `{c}` != concat('{c}-', doc_id)" for c in names)).count() == 0, name
    assert docs.count() > 0 and C.STAGES[-1][1](spark, docs, SF).count() > 0

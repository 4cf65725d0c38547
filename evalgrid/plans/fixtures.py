"""Bindings of the test tables to the evaluation data model (FIXTURES.md section 4).

Every derivation uses only integer arithmetic, ``%``, ``floor``, ``CASE`` and string
concatenation, so the DuckDB oracle (``plans/oracle_fixtures.py``) can rebuild the same rows.
Models and shot levels are expanded with ``explode`` (a generator, not a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import GRID_SHOTS, SPLITS
from ..functions.text import bleu_tokens

N_MODELS = 3
SHOTS_SQL = "array('zero_shot', 'two_shot', 'four_shot')"
SPLITS_SQL = "array(" + ", ".join(f"'{s}'" for s in SPLITS) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a base table over the shuffle partitions before a fan-out.

    The test tables are single small files (one or two scan splits); without this, the whole
    models x shots fan-out and its per-row parsing run in the scan's one or two tasks.
    """
    return df.repartition(F.col(key))  # no count: AQE sizes the partitions


def _models_shots(df: DataFrame, models: int = N_MODELS, shots: bool = True) -> DataFrame:
    # spread before the fan-out: after it each response would be shuffled here once more, besides the shuffle of its join
    out = _spread(df, df.columns[0]).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    if shots:
        out = out.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(GRID_SHOTS) - 1))))
    else:
        out = out.withColumn("s", F.lit(0))
    return out.withColumn("model", F.expr("concat('org/model-', m)")).withColumn(
        "shot", F.expr(f"element_at({SHOTS_SQL}, s + 1)")
    )


# ------------------------------------------------------------------ mc (part)

MC_SPLITS = [s for s in SPLITS if s < "2_5"]
_MC_SPLIT = "element_at(array(" + ", ".join(f"'{s}'" for s in MC_SPLITS) + f"), CAST(p_partkey % {len(MC_SPLITS)} + 1 AS INT))"
_MC_IDENT = (
    "CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL "
    "WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('part-', p_partkey) END"
)
_MC_ID = "CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE concat('id-', p_partkey) END"
_MC_RESOLVED = f"coalesce({_MC_IDENT}, {_MC_ID}, concat('example_', p_partkey))"


def mc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_mc items: one four-option question per part."""
    p = _spread(table(spark, sf_dir, "part"), "p_partkey")
    return p.selectExpr(
        f"{_MC_SPLIT} AS split",
        "CAST(p_partkey AS BIGINT) AS ord",
        f"{_MC_IDENT} AS identifier",
        f"{_MC_ID} AS id",
        "concat(CASE WHEN p_partkey % 4 = 1 THEN '  ' ELSE '' END, 'Which item is ', p_name, '?',"
        " CASE WHEN p_partkey % 10 = 0 THEN ' {x}' ELSE '' END) AS question",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('A. ', p_brand, '\\n\\n', 'B. ', p_type, '\\n',"
        " 'C. size ', p_size, '\\n', 'D. ', p_name, '\\n') END AS options",
        "substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS answer",
    )


def mc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_mc responses: part x 3 models x 3 shots, six phrasings, one letter shift in three.

    Responses with (key + m + s) % 23 = 0 carry a wrong identifier: the item has no response
    in that cell and the response has no item (both sides of J5).
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    g = _models_shots(p)
    letter = (
        "substr('ABCD', CAST((p_partkey % 4 + CASE WHEN (p_partkey + m + s) % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1)"
    )
    text = (
        f"CASE (p_partkey * 7 + m * 3 + s) % 6 "
        f"WHEN 0 THEN concat('Answer: ', {letter}) "
        f"WHEN 1 THEN concat(lower({letter}), '.') "
        f"WHEN 2 THEN concat('The option is (', {letter}, ')') "
        f"WHEN 3 THEN concat('I think it is a bolt, so ', {letter}) "
        f"WHEN 4 THEN 'none of these' "
        f"ELSE {letter} END"
    )
    return g.selectExpr(
        "model",
        f"{_MC_SPLIT} AS split",
        "shot",
        f"CASE WHEN (p_partkey + m + s) % 23 = 0 THEN concat({_MC_RESOLVED}, '#lost') ELSE {_MC_RESOLVED} END AS identifier",
        f"CASE WHEN (p_partkey + s) % 8 = 0 THEN concat('  ', {text}, '\\n') ELSE {text} END AS text",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE -CAST(p_partkey % 50 AS DOUBLE) / 10 - m END AS cumulative_logprob",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(array() AS array<int>)"
        " ELSE sequence(1, p_size) END AS token_ids",
    )


def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mc items in which every seventh part's question occurs again, later, with another gold letter."""
    items = mc_items(spark, sf_dir)
    again = items.where("ord % 7 = 0").withColumn("ord", F.expr("ord + 1000000000")).withColumn("answer", F.lit("Z"))
    return items.unionByName(again)


def repeated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mc responses in their run's order; those to every fifth part come again later, every second one with another text."""
    number = "CAST(regexp_extract(identifier, '([0-9]+)', 1) AS BIGINT)"
    r = mc_responses(spark, sf_dir).withColumn("response_no", F.expr(number))
    again = (r.where("response_no % 5 = 0").withColumn("text", F.expr("CASE WHEN response_no % 2 = 0 THEN 'Z' ELSE text END"))
             .withColumn("response_no", F.expr("response_no + 1000000000")))
    return r.unionByName(again)


def numbered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator output that numbers its requests: the item's place in its split instead of its identifier."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    return _models_shots(p).selectExpr(
        "model", f"{_MC_SPLIT} AS split", "shot", "CAST(NULL AS STRING) AS identifier",
        "substr('ABCD', CAST((p_partkey + m) % 4 + 1 AS INT), 1) AS text", "CAST(NULL AS DOUBLE) AS cumulative_logprob",
        "CAST(NULL AS array<int>) AS token_ids", "CAST(p_partkey AS BIGINT) AS request_id")


# ------------------------------------------------------------------ bool (orders)

def bool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return o.selectExpr(
        "'2_5' AS split",
        "CAST(o_orderkey AS BIGINT) AS ord",
        "concat('order-', o_orderkey) AS identifier",
        "CAST(NULL AS STRING) AS id",
        "concat('Is order ', o_orderkey, ' satisfiable?') AS question",
        "CAST(NULL AS STRING) AS options",
        "CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'False' END AS answer",
    )


def bool_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    g = _models_shots(o)
    truth = "((o_totalprice > 250000) <> ((o_orderkey + m + s) % 5 = 0))"
    word = f"CASE WHEN {truth} THEN 'True' ELSE 'False' END"
    text = (
        f"CASE (o_orderkey + m + s) % 4 "
        f"WHEN 0 THEN concat('It is ', upper({word}), '.') "
        f"WHEN 1 THEN lower({word}) "
        f"WHEN 2 THEN concat('Satisfiable: ', {word}) "
        f"ELSE 'Cannot decide' END"
    )
    return g.selectExpr(
        "model", "'2_5' AS split", "shot",
        "concat('order-', o_orderkey) AS identifier",
        f"{text} AS text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob",
        "CAST(NULL AS array<int>) AS token_ids",
    )


# ------------------------------------------------------------------ triples (lineitem by order)

_LINE = "concat('(order_', l_orderkey, ', contains, part_', l_partkey, ')')"


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its lines sorted.  Orders have a bounded number of lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return li.groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(_LINE).alias("line")))
        ).alias("lines")
    )


def triple_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_lines(spark, sf_dir)
    return o.selectExpr(
        "concat('3_', 2 + l_orderkey % 3) AS split",
        "CAST(l_orderkey AS BIGINT) AS ord",
        "concat('order-', l_orderkey) AS identifier",
        "CAST(NULL AS STRING) AS id",
        "concat('List the parts of order ', l_orderkey, ' as triples.') AS question",
        "CAST(NULL AS STRING) AS options",
        "array_join(transform(lines, x -> x.line), '\\n') AS answer",
    )


def triple_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction drops lines with (l_partkey + m + s) % 5 = 0; three layouts by (key + m + s) % 3."""
    o = _models_shots(_order_lines(spark, sf_dir))
    kept = "transform(filter(lines, x -> (x.l_partkey + m + s) % 5 <> 0), x -> x.line)"
    text = (
        f"CASE (l_orderkey + m + s) % 3 "
        f"WHEN 0 THEN array_join({kept}, '\\n') "
        f"WHEN 1 THEN concat('Triples: ', array_join({kept}, ' '), '.') "
        f"ELSE concat('[', array_join({kept}, ', '), ']') END"
    )
    return o.selectExpr(
        "model", "concat('3_', 2 + l_orderkey % 3) AS split", "shot",
        "concat('order-', l_orderkey) AS identifier",
        f"{text} AS text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob",
        "CAST(NULL AS array<int>) AS token_ids",
    )


_RELATION = ("CASE l_linenumber % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'contains, in part' ELSE 'contains, in part, late' END")
_LOT = "CASE WHEN l_suppkey % 2 = 0 THEN concat('part_', l_partkey) ELSE concat('part_', l_partkey, ', lot ', l_suppkey) END"


def _order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its lines' triples, whose relations and parts may hold commas."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    named = li.selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f"{_LOT} AS lot",
                          f"concat('(order_', l_orderkey, ', ', {_RELATION}, ', ', {_LOT}, ')') AS line")
    return named.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "lot", "line"))).alias("lines"))


def named_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple tasks whose question lists the names to use, one a line."""
    return _order_names(spark, sf_dir).selectExpr(
        "concat('3_', 2 + l_orderkey % 3) AS split", "CAST(l_orderkey AS BIGINT) AS ord", "concat('named-', l_orderkey) AS identifier",
        "CAST(NULL AS STRING) AS id",
        "concat('List the parts of the order.\\nClasses:\\n- order_', l_orderkey, '\\n- ', array_join(transform(lines, x -> x.lot), '\\n- '),"
        " '\\nObject Properties:\\n- contains\\n- contains, in part\\n- contains, in part, late') AS question",
        "CAST(NULL AS STRING) AS options", "array_join(transform(lines, x -> x.line), '\\n') AS answer")


def named_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``triple_responses``, over the named lines."""
    kept = "transform(filter(lines, x -> (x.l_partkey + m + s) % 5 <> 0), x -> x.line)"
    text = (f"CASE (l_orderkey + m + s) % 3 WHEN 0 THEN array_join({kept}, '\\n') "
            f"WHEN 1 THEN concat('Triples: ', array_join({kept}, ' '), '.') ELSE concat('[', array_join({kept}, ', '), ']') END")
    return _models_shots(_order_names(spark, sf_dir)).selectExpr(
        "model", "concat('3_', 2 + l_orderkey % 3) AS split", "shot", "concat('named-', l_orderkey) AS identifier", f"{text} AS text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob", "CAST(NULL AS array<int>) AS token_ids")


# ------------------------------------------------------------------ tuples (supplier by nation)

_PAIR = "concat('(''', s_name, ''', ''', n_name, ''')')"
PAIR_BUCKET = 100  # suppliers per item: bounds every answer list


def _supplier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn = s.join(n, s.s_nationkey == n.n_nationkey)  # nation: 25-row dimension, auto-broadcast
    return sn.groupBy("s_nationkey", F.expr(f"CAST(s_suppkey DIV {PAIR_BUCKET} AS BIGINT)").alias("bucket")).agg(
        F.first("n_name").alias("n_name"),
        F.array_sort(F.collect_list(F.struct("s_suppkey", F.expr(_PAIR).alias("pair")))).alias("pairs"),
    )


def tuple_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _supplier_groups(spark, sf_dir)
    return g.selectExpr(
        "'3_5' AS split",
        "CAST(s_nationkey * 1000000 + bucket AS BIGINT) AS ord",
        "concat('nation-', s_nationkey, '-', bucket) AS identifier",
        "CAST(NULL AS STRING) AS id",
        "concat('Align the suppliers of ', n_name, ' with their nation.') AS question",
        "CAST(NULL AS STRING) AS options",
        "concat('[', array_join(transform(pairs, x -> x.pair), ', '), ']') AS answer",
    )


def tuple_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction drops suppliers with (key + s) % 3 = m and repeats those with key % 5 = 0."""
    g = _models_shots(_supplier_groups(spark, sf_dir))
    kept = (
        "flatten(transform(filter(pairs, x -> (x.s_suppkey + s) % 3 <> m), "
        "x -> CASE WHEN x.s_suppkey % 5 = 0 THEN array(x.pair, x.pair) ELSE array(x.pair) END))"
    )
    text = (
        f"CASE (s_nationkey + m + s) % 3 "
        f"WHEN 0 THEN concat('[', array_join({kept}, ', '), ']') "
        f"WHEN 1 THEN array_join({kept}, '\\n') "
        f"ELSE array_join({kept}, ', ') END"
    )
    return g.selectExpr(
        "model", "'3_5' AS split", "shot",
        "concat('nation-', s_nationkey, '-', bucket) AS identifier",
        f"{text} AS text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob",
        "CAST(NULL AS array<int>) AS token_ids",
    )


# ------------------------------------------------------------------ open text (documents)

def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_text2: every document; the reference answer is the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.selectExpr(
        "'3_1' AS split",
        "1000000000000 + doc_id AS ord",
        "concat('doc-', doc_id) AS identifier",
        "CAST(NULL AS STRING) AS id",
        "concat('Define document ', doc_id) AS question",
        "CAST(NULL AS STRING) AS options",
        "text AS answer",
    )


def text_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction = the whole lower-cased token list minus 1-based positions i with
    (i + m + doc_id) % (4 + m) = 0, joined by spaces.  Three models, zero-shot.

    Documents are spread by id before tokenising (a small text table can be a single scan
    split) and tokenised once, not once per model.
    """
    d = _spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = d.select("doc_id", bleu_tokens(F.col("text")).alias("toks"))
    g = _models_shots(d, shots=False)
    return g.selectExpr(
        "model", "'3_1' AS split", "shot",
        "concat('doc-', doc_id) AS identifier",
        "array_join(filter(toks, (t, i) -> (i + 1 + m + doc_id) % (4 + m) <> 0), ' ') AS text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob",
        "CAST(NULL AS array<int>) AS token_ids",
    )


# ------------------------------------------------------------------ conversations (user -> next assistant turn)

def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_text: a user turn (reference) and the assistant turn right after it (prediction), whole texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"]).selectExpr(
        "'org/model-0' AS model", "'3_1' AS split", "'zero_shot' AS shot",
        "concat('conv-', conv_id, '-', turn) AS identifier", "pred", "ref",
    )


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-text items for the whole-evaluation job: the user turn is the gold answer."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'")
    return u.selectExpr(
        "'3_1' AS split", "CAST(conv_id * 100 + turn AS BIGINT) AS ord",
        "concat('conv-', conv_id, '-', turn) AS identifier", "CAST(NULL AS STRING) AS id",
        "concat('Continue conversation ', conv_id) AS question", "CAST(NULL AS STRING) AS options", "text AS answer",
    )


def conversation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turn that follows a user turn is model 0's zero-shot response to it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.where("role = 'assistant'")
    return a.selectExpr(
        "'org/model-0' AS model", "'3_1' AS split", "'zero_shot' AS shot",
        "concat('conv-', conv_id, '-', turn - 1) AS identifier", "text",
        "CAST(NULL AS DOUBLE) AS cumulative_logprob", "CAST(NULL AS array<int>) AS token_ids",
    )


# ------------------------------------------------------------------ run history, configs, padding

def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_runs: an append-only summary log.  Four models repeat 3_2 instead of running 3_4 (Q14)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    split = f"element_at({SPLITS_SQL}, CAST(event_id % 15 + 1 AS INT))"
    return e.selectExpr(
        "concat('org/model-', user_id % 17) AS model",
        f"CASE WHEN user_id % 17 IN (3, 4, 8, 9) AND {split} = '3_4' THEN '3_2' ELSE {split} END AS split",
        f"element_at({SHOTS_SQL}, CAST((event_id DIV 15) % 3 + 1 AS INT)) AS shot",
        "ts AS timestamp",
        "value AS accuracy",
        "event_id",
    )


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_config: one generation config per line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    return li.selectExpr(
        "l_orderkey", "l_linenumber",
        "4096 * (l_linenumber % 3) AS max_batched_tokens",
        "l_linenumber - 1 AS max_tokens",
        "l_discount - 0.02 AS temperature",
        "l_quantity / 40 AS top_p",
    )


def padded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_strip: document text padded with tabs, newlines, spaces and \\x1c by doc_id % 5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.selectExpr(
        "doc_id",
        "CASE doc_id % 5 WHEN 0 THEN concat('\\t', text, '\\n') WHEN 1 THEN concat('  ', text, '  ')"
        " WHEN 2 THEN concat('\\n\\n', text, ' \\t') WHEN 3 THEN concat(char(28), text, char(31)) ELSE text END AS text",
    )


# ------------------------------------------------------------------ whole evaluation inputs

def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [mc_items, bool_items, triple_items, tuple_items, conversation_items, text_items]
    out = parts[0](spark, sf_dir)
    for f in parts[1:]:
        out = out.unionByName(f(spark, sf_dir))
    return out


def all_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [mc_responses, bool_responses, triple_responses, tuple_responses, conversation_responses, text_responses]
    out = parts[0](spark, sf_dir)
    for f in parts[1:]:
        out = out.unionByName(f(spark, sf_dir))
    return out

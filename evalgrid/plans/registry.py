"""Registered queries (one per SURVEY section 2 operator) and their DuckDB oracles.

Every query reads the test tables through ``plans/fixtures.py`` -- whole tables, no id
subsets -- and returns a DataFrame whose column names equal the oracle's.  Doubles are
rounded to 6 decimals on both sides; tuple lists are rendered as ``(a|b)(c|d)`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import text as tx
from ..functions import treebank as tb
from ..functions.stem import last_choice, letter_kinds, stem_steps
from ..operators import extract as ex
from ..operators import pairing as pr
from ..operators import prompting as pm
from ..operators import score_exact as se
from ..schemas import METRICS as _METRICS
from ..sources import rejects as rj
from . import fixtures as fx
from . import oracle_fixtures as ofx
from . import sqlfn as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# =============================================================== P5 / P6 / P8 / S9 / S10

@register("p5_identifier", f"""
SELECT split, ord, coalesce(identifier, id, 'example_' || ord) AS identifier FROM {ofx.mc_items()}""")
def p5_identifier(spark, sf):
    return pr.resolve_identifier(fx.mc_items(spark, sf)).select("split", "ord", "identifier")


@register("p6_strip", f"""
SELECT doc_id, {q.strip('text')} AS stripped, length({q.strip('text')}) AS n_chars FROM {ofx.padded_documents()}""")
def p6_strip(spark, sf):
    d = fx.padded_documents(spark, sf)
    s = tx.py_strip(F.col("text"))
    return d.select("doc_id", s.alias("stripped"), F.length(s).alias("n_chars"))


@register("p8_token_count", f"""
SELECT model, split, shot, identifier, cumulative_logprob AS log_probability,
  CAST(greatest(coalesce(len(token_ids), 0), 1) AS BIGINT) AS token_count
FROM {ofx.mc_responses()}""")
def p8_token_count(spark, sf):
    r = fx.mc_responses(spark, sf)
    return r.select("model", "split", "shot", "identifier", F.col("cumulative_logprob").alias("log_probability"),
                    pr.token_count().alias("token_count"))


@register("s9_model_safe", f"""
SELECT DISTINCT model, translate(model, '/-', '__') AS model_safe FROM {ofx.run_history()}""")
def s9_model_safe(spark, sf):
    return fx.run_history(spark, sf).select("model", tx.model_safe(F.col("model")).alias("model_safe")).distinct()


_S10_PATH_SPARK = (
    "concat('./prompt/bench_', split, '/', CASE event_id % 7 WHEN 0 THEN 'Two_Shot.txt' WHEN 1 THEN 'fewshot.txt'"
    " WHEN 2 THEN concat(shot, '_v2.TXT') WHEN 3 THEN concat(shot, '/prompt.txt') ELSE concat(shot, '.txt') END)"
)
_S10_PATH_SQL = (
    "'./prompt/bench_' || split || '/' || CASE event_id % 7 WHEN 0 THEN 'Two_Shot.txt' WHEN 1 THEN 'fewshot.txt'"
    " WHEN 2 THEN shot || '_v2.TXT' WHEN 3 THEN shot || '/prompt.txt' ELSE shot || '.txt' END"
)


@register("s10_shot_label", f"""
SELECT event_id, path,
  CASE WHEN regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '(zero|one|two|three|four)_shot', 1, 'i') <> ''
    THEN lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '(zero|one|two|three|four)_shot', 1, 'i')) END AS shot_label
FROM (SELECT event_id, {_S10_PATH_SQL} AS path FROM {ofx.run_history()})""")
def s10_shot_label(spark, sf):
    h = fx.run_history(spark, sf).select("event_id", F.expr(_S10_PATH_SPARK).alias("path"))
    return h.select("event_id", "path", tx.shot_label(F.col("path")).alias("shot_label"))


@register("p11_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events""")
def p11_timestamp(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tx.iso_timestamp(F.col("ts")).alias("timestamp"))


# =============================================================== P1 config predicates

@register("p1_config_check", f"""
SELECT CASE WHEN max_batched_tokens <= 0 THEN {ofx.sql_str(pm.BAD_BATCHED_TOKENS)}
            WHEN max_tokens <= 0 THEN {ofx.sql_str(pm.BAD_MAX_TOKENS)}
            WHEN temperature < 0 THEN {ofx.sql_str(pm.BAD_TEMPERATURE)}
            WHEN NOT (top_p >= 0 AND top_p <= 1) THEN {ofx.sql_str(pm.BAD_TOP_P)}
            ELSE 'ok' END AS reason, count(*) AS n
FROM {ofx.run_configs()} GROUP BY 1""")
def p1_config_check(spark, sf):
    c = fx.run_configs(spark, sf)
    return c.groupBy(F.coalesce(pm.config_reject_reason(c), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# =============================================================== P2 question block, P4 task type

def _block_sql(items: str) -> str:
    mcq = "((split LIKE '%1\\_%' ESCAPE '\\' OR split LIKE '%2\\_%' ESCAPE '\\') AND split <> '2_5')"
    return f"""SELECT split, identifier,
  CASE WHEN {mcq} THEN {q.strip('question')} || chr(10) || replace({q.strip("coalesce(options, '')")}, chr(10) || chr(10), chr(10))
       ELSE {q.strip('question')} || chr(10) END AS question_block
FROM {items}"""


@register("p2_question_block", _block_sql(
    f"(SELECT split, coalesce(identifier, id, 'example_' || ord) AS identifier, question, options FROM "
    f"(SELECT * FROM {ofx.mc_items()} UNION ALL SELECT * FROM {ofx.bool_items()} UNION ALL SELECT * FROM {ofx.triple_items()}))"))
def p2_question_block(spark, sf):
    from ..operators.prompting import question_block
    items = fx.mc_items(spark, sf).unionByName(fx.bool_items(spark, sf)).unionByName(fx.triple_items(spark, sf))
    items = pr.resolve_identifier(items)
    return items.select("split", "identifier", question_block(F.col("split"), F.col("question"), F.col("options")).alias("question_block"))


@register("p4_task_type", f"""
SELECT a.split, coalesce(c.task_type, 'mc') AS task_type, c.task_type IS NULL AS is_unknown_split, count(*) AS n
FROM (SELECT split FROM {ofx.all_items()} UNION ALL SELECT split FROM {ofx.run_history()}
      UNION ALL SELECT event_type AS split FROM events) a
LEFT JOIN {cat.catalog_values_sql()} c ON a.split = c.split
GROUP BY 1, 2, 3""")
def p4_task_type(spark, sf):
    splits = (fx.all_items(spark, sf).select("split")
              .unionByName(fx.run_history(spark, sf).select("split"))
              .unionByName(fx.table(spark, sf, "events").select(F.col("event_type").alias("split"))))
    typed = cat.with_task_type(splits, cat.task_catalog(spark))
    return typed.groupBy("split", "task_type", "is_unknown_split").agg(F.count(F.lit(1)).alias("n"))


# =============================================================== E1 / E2

@register("e1_choice", f"""
SELECT model, split, shot, identifier, {q.e1('text')} AS pred_text FROM {ofx.mc_responses()}""")
def e1_choice(spark, sf):
    r = fx.mc_responses(spark, sf)
    return r.select("model", "split", "shot", "identifier", ex.extract_choice(F.col("text")).alias("pred_text"))


@register("e2_bool", f"""
SELECT model, split, shot, identifier, {q.e2('text')} AS pred_text FROM {ofx.bool_responses()}""")
def e2_bool(spark, sf):
    r = fx.bool_responses(spark, sf)
    return r.select("model", "split", "shot", "identifier", ex.extract_bool(F.col("text")).alias("pred_text"))


# =============================================================== J1 / J5

_MC_PAIRED_SQL = f"""(SELECT r.model, r.split, r.shot, i.identifier, i.ord, i.answer, r.text
  FROM {ofx.mc_responses()} r JOIN (SELECT split, ord, coalesce(identifier, id, 'example_' || ord) AS identifier, answer
                                    FROM {ofx.mc_items()}) i ON r.split = i.split AND r.identifier = i.identifier)"""


@register("j1_item_response", f"SELECT model, split, shot, identifier, ord FROM {_MC_PAIRED_SQL}")
def j1_item_response(spark, sf):
    return pr.pair(fx.mc_items(spark, sf), fx.mc_responses(spark, sf)).select("model", "split", "shot", "identifier", "ord")


@register("j5_coverage", f"""
WITH it AS (SELECT split, coalesce(identifier, id, 'example_' || ord) AS identifier FROM {ofx.mc_items()}),
     rs AS (SELECT model, split, shot, identifier FROM {ofx.mc_responses()}),
     cells AS (SELECT DISTINCT model, split, shot FROM rs)
SELECT 'missing_response' AS kind, c.model, c.split, c.shot, it.identifier
FROM it JOIN cells c ON it.split = c.split
WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.model = c.model AND rs.split = c.split AND rs.shot = c.shot AND rs.identifier = it.identifier)
UNION ALL
SELECT 'orphan_response', rs.model, rs.split, rs.shot, rs.identifier FROM rs
WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.split = rs.split AND it.identifier = rs.identifier)""")
def j5_coverage(spark, sf):
    items, resp = fx.mc_items(spark, sf), fx.mc_responses(spark, sf)
    cells = resp.select("model", "split", "shot").distinct()
    return pr.coverage(items, resp, cells)


_OCCURRENCE_SQL = f"""(SELECT rs.model, rs.split, rs.shot, it.identifier, it.ord, {q.e1('rs.text')} AS pred_text, it.answer
  FROM (SELECT *, row_number() OVER (PARTITION BY model, split, shot, identifier ORDER BY response_no) AS k FROM {ofx.repeated_responses()}) rs
  JOIN (SELECT split, ord, coalesce(identifier, id, 'example_' || ord) AS identifier, answer,
          row_number() OVER (PARTITION BY split, coalesce(identifier, id, 'example_' || ord) ORDER BY ord) AS k FROM {ofx.repeated_items()}) it
    ON rs.split = it.split AND rs.identifier = it.identifier AND rs.k = it.k)"""


@register("j1_occurrence", f"""
SELECT model, split, shot, identifier, ord, pred_text, coalesce(pred_text = {q.strip('answer')}, false) AS match FROM {_OCCURRENCE_SQL}""")
def j1_occurrence(spark, sf):
    """Repeated identifiers: the k-th response to one meets the k-th item that has it."""
    from .evaluate import extract
    e = extract(spark, fx.repeated_items(spark, sf), fx.repeated_responses(spark, sf), families=(False,))
    return e.select("model", "split", "shot", "identifier", "ord", "pred_text", "match")


@register("j1_duplicates", f"""
WITH n AS (SELECT split, count(*) AS n_items FROM {ofx.repeated_items()} GROUP BY 1)
SELECT p.model, p.split, p.shot, CAST(sum(CASE WHEN coalesce(p.pred_text = {q.strip('p.answer')}, false) THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  n.n_items FROM {_OCCURRENCE_SQL} p JOIN n ON n.split = p.split GROUP BY ALL""")
def j1_duplicates(spark, sf):
    """Accuracy where identifiers repeat: every item counts, and each of its responses meets its own item."""
    from .evaluate import extract
    items = fx.repeated_items(spark, sf)
    a = se.accuracy(extract(spark, items, fx.repeated_responses(spark, sf), families=(False,)), items)
    return a.select("model", "split", "shot", "correct", "n_items")


@register("j1_request_order", f"""
SELECT r.model, r.split, r.shot, coalesce(i.identifier, i.id, 'example_' || i.ord) AS identifier, i.ord,
  r.text = {q.strip('i.answer')} AS match
FROM {ofx.numbered_responses()} r JOIN {ofx.mc_items()} i ON r.split = i.split AND r.request_id = i.ord""")
def j1_request_order(spark, sf):
    """Responses that carry a request number instead of an identifier pair by place."""
    from .evaluate import extract
    e = extract(spark, fx.mc_items(spark, sf), fx.numbered_responses(spark, sf), families=(False,))
    return e.select("model", "split", "shot", "identifier", "ord", "match")


# =============================================================== M1 / M2

_CLOSED_PAIRED_SQL = f"""(SELECT r.model, r.split, r.shot, i.identifier, i.answer,
    CASE WHEN r.split = '2_5' THEN {q.e2('r.text')} ELSE {q.e1('r.text')} END AS pred_text
  FROM (SELECT * FROM {ofx.mc_responses()} UNION ALL SELECT * FROM {ofx.bool_responses()}) r
  JOIN (SELECT split, coalesce(identifier, id, 'example_' || ord) AS identifier, answer
        FROM (SELECT * FROM {ofx.mc_items()} UNION ALL SELECT * FROM {ofx.bool_items()})) i
    ON r.split = i.split AND r.identifier = i.identifier)"""


def _closed_extracted(spark, sf, mode="reference"):
    from .evaluate import extract
    items = fx.mc_items(spark, sf).unionByName(fx.bool_items(spark, sf))
    resp = fx.mc_responses(spark, sf).unionByName(fx.bool_responses(spark, sf))
    return items, extract(spark, items, resp, mode, (False,))


@register("m1_match", f"""
SELECT model, split, shot, identifier, pred_text, coalesce(pred_text = {q.strip('answer')}, false) AS match
FROM {_CLOSED_PAIRED_SQL}""")
def m1_match(spark, sf):
    _, e = _closed_extracted(spark, sf)
    return e.select("model", "split", "shot", "identifier", "pred_text", "match")


def _r6_sql(x: str) -> str:
    return f"round({x}, 6)"


def _acc_sql(rounded=_r6_sql) -> str:
    return f"""
WITH s AS (SELECT model, split, shot, CAST(sum(CASE WHEN coalesce(pred_text = {q.strip('answer')}, false) THEN 1 ELSE 0 END) AS BIGINT) AS correct
           FROM {_CLOSED_PAIRED_SQL} GROUP BY 1, 2, 3),
     n AS (SELECT split, count(*) AS n_items FROM (SELECT split FROM {ofx.mc_items()} UNION ALL SELECT split FROM {ofx.bool_items()}) GROUP BY 1)
SELECT s.model, s.split, s.shot, s.correct, n.n_items, {rounded(q.safe_div('s.correct', 'n.n_items'))} AS accuracy
FROM s JOIN n ON s.split = n.split"""


@register("m2_accuracy", _acc_sql())
def m2_accuracy(spark, sf):
    items, e = _closed_extracted(spark, sf)
    a = se.accuracy(e, items)
    return a.select("model", "split", "shot", "correct", "n_items", r6(F.col("accuracy")).alias("accuracy"))


# =============================================================== E4-E7 tuple extraction

def _tuple_out(df, col):
    parsed = df.select("model", "split", "shot", "identifier", col.alias("_t"))  # parsed once for both columns
    return parsed.select("model", "split", "shot", "identifier", F.size("_t").cast("bigint").alias("n_tuples"),
                         ex.render_tuples(F.col("_t")).alias("tuples"))


def _tuple_out_sql(src: str, expr: str) -> str:
    return f"""SELECT model, split, shot, identifier, CAST(len(t) AS BIGINT) AS n_tuples, {q.render('t')} AS tuples
FROM (SELECT model, split, shot, identifier, {expr} AS t FROM {src})"""


@register("e4_tuple_literal", _tuple_out_sql(ofx.tuple_responses(), q.e4(q.strip("text"))))
def e4_tuple_literal(spark, sf):
    r = fx.tuple_responses(spark, sf)
    return _tuple_out(r, ex.literal_tuples(tx.py_strip(F.col("text"))))


@register("e5_tuple_regex", _tuple_out_sql(ofx.triple_responses(), q.e5(q.strip("text"))))
def e5_tuple_regex(spark, sf):
    r = fx.triple_responses(spark, sf)
    return _tuple_out(r, ex.regex_tuples(tx.py_strip(F.col("text"))))


@register("e6_tuple_cascade", _tuple_out_sql(ofx.tuple_responses(), q.cascade(q.strip("text"))))
def e6_tuple_cascade(spark, sf):
    r = fx.tuple_responses(spark, sf)
    return _tuple_out(r, ex.parse_tuples(F.col("text")))


@register("e7_triple_arity", _tuple_out_sql(
    ofx.triple_responses(), f"list_filter({q.cascade(q.strip('text'))}, lambda t: len(t) = 3)"))
def e7_triple_arity(spark, sf):
    r = fx.triple_responses(spark, sf)
    return _tuple_out(r, ex.keep_triples(ex.parse_tuples(F.col("text"))))


# =============================================================== M3 / M4 micro F1

def _f1_sql(resp: str, items: str, arity3: bool, positional: bool, rounded=_r6_sql) -> str:
    def parse(x):
        c = q.cascade(q.strip(x))
        return f"list_filter({c}, lambda t: len(t) = 3)" if arity3 else c
    if positional:
        tp = "len(list_filter(p, lambda x, i: i <= len(r) AND x = r[i]))"
        counts = f"{tp} AS tp, greatest(len(p) - {tp}, 0) AS fp, greatest(len(r) - {tp}, 0) AS fn"
    else:
        counts = ("len(list_intersect(list_distinct(p), list_distinct(r))) AS tp, "
                  "len(list_filter(list_distinct(p), lambda x: NOT list_contains(r, x))) AS fp, "
                  "len(list_filter(list_distinct(r), lambda x: NOT list_contains(p, x))) AS fn")
    return f"""WITH pairs AS (
  SELECT r.model, r.split, r.shot, {parse('r.text')} AS p, {parse('i.answer')} AS r
  FROM {resp} r JOIN {items} i ON r.split = i.split AND r.identifier = i.identifier),
c AS (SELECT model, split, shot, {counts} FROM pairs),
s AS (SELECT model, split, shot, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
      FROM c GROUP BY 1, 2, 3),
m AS (SELECT *, {q.safe_div('tp', 'tp + fp')} AS precision, {q.safe_div('tp', 'tp + fn')} AS recall FROM s)
SELECT model, split, shot, tp, fp, fn, {rounded('precision')} AS precision, {rounded('recall')} AS recall,
  {rounded(q.f1('precision', 'recall'))} AS f1 FROM m"""


def _f1_out(df):
    return df.select("model", "split", "shot", "tp", "fp", "fn", r6(F.col("precision")).alias("precision"),
                     r6(F.col("recall")).alias("recall"), r6(F.col("f1")).alias("f1"))


def _open_extracted(spark, sf, items_fn, resp_fn, mode="reference"):
    from .evaluate import extract
    return extract(spark, items_fn(spark, sf), resp_fn(spark, sf), mode, (True,))


@register("m3_tuple_f1", _f1_sql(ofx.tuple_responses(), ofx.tuple_items(), arity3=False, positional=False))
def m3_tuple_f1(spark, sf):
    from ..operators.score_tuples import tuple_f1
    e = _open_extracted(spark, sf, fx.tuple_items, fx.tuple_responses)
    return _f1_out(tuple_f1(e))


@register("m4_triple_f1", _f1_sql(ofx.triple_responses(), ofx.triple_items(), arity3=True, positional=True))
def m4_triple_f1(spark, sf):
    from ..operators.score_tuples import triple_f1
    e = _open_extracted(spark, sf, fx.triple_items, fx.triple_responses)
    return _f1_out(triple_f1(e))


@register("q7_triple_set_f1", _f1_sql(ofx.triple_responses(), ofx.triple_items(), arity3=True, positional=False))
def q7_triple_set_f1(spark, sf):
    """Q7 corrected: the order of triples doesn't matter."""
    from ..operators.score_tuples import tuple_f1
    e = _open_extracted(spark, sf, fx.triple_items, fx.triple_responses)
    return _f1_out(tuple_f1(e))


def _vocabulary_sql() -> str:
    # names as alternatives of one pattern, the longest first; each match ends at a comma
    longest = "list_transform(list_sort(list_transform(i.names, lambda n: {'l': -length(n), 'n': n})), lambda x: regexp_escape(x.n))"

    def triples(text):
        spans = f"regexp_extract_all(translate({text}, '[{{]}}', '(())'), '\\(([^()]*)\\)', 1)"
        return f"list_filter(list_transform({spans}, lambda sp: regexp_extract_all(sp || ',', pat, 1)), lambda t: len(t) = 3)"
    return f"""WITH j AS (
  SELECT r.model, r.split, r.shot, i.identifier, r.text, i.answer, '\\s*(' || array_to_string({longest}, '|') || '|[^,]*?)\\s*,' AS pat
  FROM {ofx.named_responses()} r JOIN {ofx.named_items()} i ON r.split = i.split AND r.identifier = i.identifier)
SELECT model, split, shot, identifier, {q.render(triples('text'))} AS tuples, {q.render(triples('answer'))} AS gold FROM j"""


@register("q5_vocabulary_match", _vocabulary_sql())
def q5_vocabulary_match(spark, sf):
    """Q5 corrected: names that the question lists stay whole although they hold commas."""
    e = _open_extracted(spark, sf, fx.named_items, fx.named_responses, "corrected")
    return e.select("model", "split", "shot", "identifier", ex.render_tuples(F.col("pred_tuples")).alias("tuples"),
                    ex.render_tuples(F.col("ref_tuples")).alias("gold"))


# =============================================================== M5-M9 text metrics

def _doc_pairs(spark, sf):
    it = fx.text_items(spark, sf).select("split", "identifier", F.col("answer").alias("ref"))
    rs = fx.text_responses(spark, sf).select("model", "split", "shot", "identifier", F.col("text").alias("pred"))
    return rs.join(it, ["split", "identifier"])


_DOC_PAIRS_SQL = f"""(SELECT r.model, r.split, r.shot, r.identifier, r.text AS pred, i.answer AS ref
  FROM {ofx.text_responses()} r JOIN {ofx.text_items()} i ON r.split = i.split AND r.identifier = i.identifier)"""

_ROUGE_PAT = "'[a-z0-9]+'"
_KEY = "model, split, shot, identifier"


def _stem_ctes(words: str) -> str:
    """CTEs ending in ``st`` (word, stem) for a subquery of distinct words."""
    steps = stem_steps()
    chain = [f"st0 AS (SELECT word, word AS w, {letter_kinds('word')} AS p FROM {words})"]
    chain += [f"st{i} AS (SELECT word, {w} AS w, {p} AS p FROM st{i - 1})" for i, (w, p) in enumerate(steps, 1)]
    return ", ".join(chain) + f", st AS (SELECT word, {last_choice()} AS stem FROM st{len(steps)})"


def _stemmed_tokens_sql() -> str:
    """CTEs from ``plain_tok`` to ``tok``: ROUGE tokens of more than three letters replaced by their stems, each distinct word stemmed once."""
    sides = " UNION ALL ".join(f"SELECT {_KEY}, '{c}' AS side, unnest({c}) AS t, generate_subscripts({c}, 1) AS pos FROM plain_tok" for c in ("pr", "rr"))
    return f"""ex AS ({sides}),
{_stem_ctes("(SELECT DISTINCT t AS word FROM ex WHERE length(t) > 3)")},
lists AS (SELECT {_KEY}, side, list(coalesce(stem, t) ORDER BY pos) AS ts FROM ex LEFT JOIN st ON t = word GROUP BY ALL),
tok AS (SELECT t.* REPLACE (coalesce(p.ts, CAST([] AS VARCHAR[])) AS pr, coalesce(r.ts, CAST([] AS VARCHAR[])) AS rr) FROM plain_tok t
  LEFT JOIN (SELECT * FROM lists WHERE side = 'pr') p USING ({_KEY}) LEFT JOIN (SELECT * FROM lists WHERE side = 'rr') r USING ({_KEY})),
"""


def _overlap_sql(pairs: str, families=(("b", 4), ("r", 2)), stem: bool = False) -> str:
    """CTE chain ending in ``sc``: both tokenisations of each pair plus clipped overlap counts
    b1..b4 (BLEU tokens) and r1..r2 (ROUGE tokens); families not requested count 0.

    n-grams are built from the unnested tokens with ``lead`` over (pair, side) ordered by position.
    """
    cols = {"b": ("pb", "rb"), "r": ("pr", "rr")}
    units, grams = [], []
    for fam, n_max in families:
        p_t, r_t = cols[fam]
        units.append(f"SELECT {_KEY}, '{fam}' AS fam, 'p' AS side, unnest({p_t}) AS t, generate_subscripts({p_t}, 1) AS pos FROM tok")
        units.append(f"SELECT {_KEY}, '{fam}', 'r', unnest({r_t}), generate_subscripts({r_t}, 1) FROM tok")
        for n in range(1, n_max + 1):
            gram = " || ' ' || ".join(["t"] + [f"lead(t, {k}) OVER win" for k in range(1, n)])
            grams.append(f"SELECT {_KEY}, fam, side, {n} AS n, {gram} AS g FROM u WHERE fam = '{fam}' "
                         f"WINDOW win AS (PARTITION BY {_KEY}, fam, side ORDER BY pos)")
    sel = []
    for fam, top in (("b", 4), ("r", 2)):
        for n in range(1, top + 1):
            sel.append(f"coalesce(sum(least(cp, cr)) FILTER (WHERE fam = '{fam}' AND n = {n}), 0) AS {fam}{n}")
    outs = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("b1", "b2", "b3", "b4", "r1", "r2"))
    return f"""{"plain_tok" if stem else "tok"} AS (
  SELECT {_KEY}, regexp_extract_all(lower(pred), {ofx.BLEU_PAT}) AS pb, regexp_extract_all(lower(ref), {ofx.BLEU_PAT}) AS rb,
    regexp_extract_all(lower(pred), {_ROUGE_PAT}) AS pr, regexp_extract_all(lower(ref), {_ROUGE_PAT}) AS rr
  FROM (SELECT {_KEY}, {q.strip('pred')} AS pred, {q.strip('ref')} AS ref FROM {pairs})),
{_stemmed_tokens_sql() if stem else ""}u AS ({" UNION ALL ".join(units)}),
gr AS ({" UNION ALL ".join(grams)}),
pg AS (SELECT {_KEY}, fam, n, g, count(*) FILTER (WHERE side = 'p') AS cp, count(*) FILTER (WHERE side = 'r') AS cr
       FROM gr WHERE g IS NOT NULL GROUP BY ALL),
cl AS (SELECT {_KEY}, {", ".join(sel)} FROM pg GROUP BY ALL),
sc AS (SELECT t.*, {outs} FROM tok t LEFT JOIN cl USING (model, split, shot, identifier))"""


_BLEU_SQL = """CASE WHEN b1 = 0 OR b2 = 0 OR b3 = 0 OR b4 = 0 THEN 0.0 ELSE
  (CASE WHEN len(pb) > len(rb) THEN 1.0 WHEN len(pb) = 0 THEN 0.0 ELSE exp(1 - len(rb) / len(pb)) END)
  * exp((ln(b1 / greatest(len(pb), 1)) + ln(b2 / greatest(len(pb) - 1, 1)) + ln(b3 / greatest(len(pb) - 2, 1))
        + ln(b4 / greatest(len(pb) - 3, 1))) / 4) END"""


def _rouge_n_sql(n: int) -> str:
    p = f"(r{n} / greatest(len(pr) - {n - 1}, 1))"
    r = f"(r{n} / greatest(len(rr) - {n - 1}, 1))"
    return q.f1(p, r)


def _lcs_sql(a: str, b: str) -> str:
    inner = (f"list_reduce(range(1, len({b}) + 1), lambda cur, j: list_append(cur, CASE WHEN x = {b}[j] THEN prev[j] + 1 "
             f"ELSE greatest(prev[j + 1], cur[j]) END), [0])")
    full = f"list_reduce({a}, lambda prev, x: {inner}, list_transform(range(len({b}) + 1), lambda k: 0))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {full}[len({b}) + 1] END)"


def _rouge_l_sql() -> str:
    return (f"CASE WHEN len(pr) = 0 OR len(rr) = 0 THEN 0.0 ELSE "
            f"{q.f1('lcs / len(pr)', 'lcs / len(rr)')} END")


def _scores(spark, sf, pairs_fn=_doc_pairs, metrics=None):
    from ..operators.score_text import text_scores
    return text_scores(pairs_fn(spark, sf), metrics=metrics)


@register("m5_bleu", f"WITH {_overlap_sql(_DOC_PAIRS_SQL, (('b', 4),))} SELECT {_KEY}, round({_BLEU_SQL}, 6) AS bleu FROM sc")
def m5_bleu(spark, sf):
    return _scores(spark, sf, metrics=["bleu"]).select("model", "split", "shot", "identifier", r6(F.col("bleu")).alias("bleu"))


@register("m6_rouge1", f"WITH {_overlap_sql(_DOC_PAIRS_SQL, (('r', 1),))} SELECT {_KEY}, round({_rouge_n_sql(1)}, 6) AS rouge1 FROM sc")
def m6_rouge1(spark, sf):
    return _scores(spark, sf, metrics=["rouge1"]).select("model", "split", "shot", "identifier", r6(F.col("rouge1")).alias("rouge1"))


@register("m7_rouge2", f"WITH {_overlap_sql(_DOC_PAIRS_SQL, (('r', 2),))} SELECT {_KEY}, round({_rouge_n_sql(2)}, 6) AS rouge2 FROM sc")
def m7_rouge2(spark, sf):
    return _scores(spark, sf, metrics=["rouge2"]).select("model", "split", "shot", "identifier", r6(F.col("rouge2")).alias("rouge2"))


@register("m8_rougeL", f"""WITH tok AS (
  SELECT {_KEY}, regexp_extract_all(lower(pred), {_ROUGE_PAT}) AS pr, regexp_extract_all(lower(ref), {_ROUGE_PAT}) AS rr
  FROM (SELECT {_KEY}, {q.strip('pred')} AS pred, {q.strip('ref')} AS ref FROM {_DOC_PAIRS_SQL})),
l AS (SELECT *, len(pr) AS lcs FROM tok)
SELECT {_KEY}, CAST(lcs AS BIGINT) AS lcs, round({_rouge_l_sql()}, 6) AS rougeL FROM l""")
def m8_rougeL(spark, sf):
    """Whole documents.  Each fixture prediction is its reference with tokens left out, so the oracle knows the LCS:
    all of the prediction's tokens.  ``m8_rougeL_conv`` checks the general case by the row recurrence."""
    return _scores(spark, sf, metrics=["rougeL"]).select("model", "split", "shot", "identifier", "lcs", r6(F.col("rougeL")).alias("rougeL"))


def _conv_pairs(spark, sf):
    return fx.conversation_pairs(spark, sf)


@register("m8_rougeL_conv", f"""WITH tok AS (
  SELECT {_KEY}, regexp_extract_all(lower(pred), {_ROUGE_PAT}) AS pr, regexp_extract_all(lower(ref), {_ROUGE_PAT}) AS rr
  FROM (SELECT {_KEY}, {q.strip('pred')} AS pred, {q.strip('ref')} AS ref FROM {ofx.conversation_pairs()})),
l AS (SELECT *, {_lcs_sql('rr', 'pr')} AS lcs FROM tok)
SELECT {_KEY}, CAST(lcs AS BIGINT) AS lcs, round({_rouge_l_sql()}, 6) AS rougeL FROM l""")
def m8_rougeL_conv(spark, sf):
    return _scores(spark, sf, _conv_pairs, ["rougeL"]).select("model", "split", "shot", "identifier", "lcs", r6(F.col("rougeL")).alias("rougeL"))


def _text_pairs(spark, sf):
    pairs = _conv_pairs(spark, sf)
    return pairs.unionByName(_doc_pairs(spark, sf).select(pairs.columns))


def _text_summary_sql(rounded=_r6_sql, stem: bool = False) -> str:
    pairs = f"(SELECT * FROM {ofx.conversation_pairs()} UNION ALL SELECT * FROM {_DOC_PAIRS_SQL})"
    return f"""WITH {_overlap_sql(pairs, stem=stem)},
l AS (SELECT *, CASE WHEN identifier LIKE 'doc-%' THEN len(pr) ELSE {_lcs_sql('rr', 'pr')} END AS lcs FROM sc),
s AS (SELECT model, split, shot, {_BLEU_SQL} AS bleu, {_rouge_n_sql(1)} AS rouge1, {_rouge_n_sql(2)} AS rouge2,
        {_rouge_l_sql()} AS rougeL FROM l)
SELECT model, split, shot, {", ".join(f"{rounded(f'coalesce(avg({c}), 0.0)')} AS {c}" for c in ("bleu", "rouge1", "rouge2", "rougeL"))}, count(*) AS n_pairs
FROM s GROUP BY ALL"""


@register("m9_text_summary", _text_summary_sql())
def m9_text_summary(spark, sf):
    from ..operators.score_text import text_summary
    s = text_summary(_scores(spark, sf, _text_pairs))
    return s.select("model", "split", "shot", *[r6(F.col(c)).alias(c) for c in ("bleu", "rouge1", "rouge2", "rougeL")], "n_pairs")


@register("m6_stem_dictionary", f"""
WITH {_stem_ctes(f"(SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), {_ROUGE_PAT})) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE length(word) > 3)")}
SELECT word, stem FROM st""")
def m6_stem_dictionary(spark, sf):
    """The stems of the whole vocabulary of documents and conversations."""
    from ..operators.score_text import stem_dictionary
    texts = fx.table(spark, sf, "documents").select("text").unionByName(fx.table(spark, sf, "conversations").select("text"))
    return stem_dictionary(texts)


_TREEBANK_WORDS = lambda t: f"regexp_split_to_array({q.strip(f'lower({t})')}, {ofx.sql_str(tb.SPACES)})"


def _abbreviation_ctes(texts: str) -> str:
    """CTEs ending in ``abbr`` (word), learned from the ``text`` column of a subquery."""
    return f"""ty AS (SELECT CASE WHEN e THEN left(w, length(w) - 1) ELSE w END AS word, e FROM (
  SELECT w, right(w, 1) = '.' AND right(w, 2) <> '..' AS e FROM (
    SELECT regexp_replace(w, {ofx.sql_str(tb.AROUND_PATTERN)}, '', 'g') AS w FROM (SELECT unnest({_TREEBANK_WORDS('text')}) AS w FROM {texts})) WHERE w <> '')),
ct AS (SELECT word, count(*) FILTER (WHERE e) AS a, count(*) FILTER (WHERE NOT e) AS b FROM ty GROUP BY word),
sh AS (SELECT sum(a) / sum(a + b) AS share FROM ct),
ab AS (SELECT word, a, b, share, length(word) - length(replace(word, '.', '')) AS inn FROM ct, sh WHERE a > 0 AND share < 1 AND regexp_matches(word, '\\p{{L}}')),
abbr AS (SELECT word FROM ab WHERE -2 * (a * (ln(share) - ln({tb.ABBREVIATION_PERIOD})) + b * (ln(1 - share) - ln(1 - {tb.ABBREVIATION_PERIOD})))
  * exp(-(length(word) - inn)) * (inn + 1) * pow(length(word) - inn, -b) >= {tb.ABBREVIATION_SCORE}),
known AS (SELECT coalesce(list(word), CAST([] AS VARCHAR[])) AS known FROM abbr)"""


def _treebank_sql(text: str) -> str:
    """The token list of a column beside ``known``."""
    core = f"regexp_replace(w, {ofx.sql_str(tb.CLOSERS_PATTERN)}, '')"
    opened = ofx.sql_str(r"^[(\"'\[{<«“‘„]+|\.$")
    marked = (f"w || CASE WHEN right({core}, 1) IN ('?', '!') OR (right({core}, 1) = '.' AND right({core}, 2) <> '..' "
              f"AND NOT list_contains(known, regexp_replace({core}, {opened}, '', 'g'))) THEN chr(10) ELSE ' ' END")
    rules = "trim(s)"
    for pattern, new in tb.RULES:
        rules = f"regexp_replace({rules}, {ofx.sql_str(pattern)}, {ofx.sql_str(new)}, 'g')"
    parts = f"list_filter(string_split(array_to_string(list_transform({_TREEBANK_WORDS(text)}, lambda w: {marked}), ''), chr(10)), lambda s: trim(s) <> '')"
    return f"list_filter(flatten(list_transform({parts}, lambda s: regexp_split_to_array(trim({rules}), ' +'))), lambda t: t <> '')"


_ALL_TEXTS_SQL = ("(SELECT 'doc-' || doc_id AS key, text FROM documents UNION ALL "
                  "SELECT 'conv-' || conv_id || '-' || turn, text FROM conversations)")


@register("m5_treebank_tokens", f"""WITH {_abbreviation_ctes(_ALL_TEXTS_SQL)}
SELECT key, CAST(len(ts) AS INTEGER) AS n_tokens, md5(array_to_string(ts, chr(10))) AS tokens_md5
FROM (SELECT key, {_treebank_sql('text')} AS ts FROM {_ALL_TEXTS_SQL}, known)""")
def m5_treebank_tokens(spark, sf):
    """Treebank tokens of all documents and turns."""
    docs = fx.table(spark, sf, "documents").selectExpr("concat('doc-', doc_id) AS key", "text")
    texts = docs.unionByName(fx.table(spark, sf, "conversations").selectExpr("concat('conv-', conv_id, '-', turn) AS key", "text"))
    texts = texts.repartition(F.col("key"))  # a file may be one scan task; no count: AQE sizes the partitions
    known = texts.withColumn("known", tb.as_list(tb.learn_abbreviations(texts)))
    t = known.select("key", tb.treebank_tokens(F.col("text"), F.col("known")).alias("ts"))
    return t.select("key", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", "\n").cast("binary")).alias("tokens_md5"))


_BOTH_PAIRS_SQL = f"(SELECT * FROM {ofx.conversation_pairs()} UNION ALL SELECT * FROM {_DOC_PAIRS_SQL})"
_TREEBANK_GRAMS_SQL = " UNION ALL ".join(
    f"SELECT {_KEY}, '{c}' AS side, {n} AS n, t{''.join(f' || chr(32) || lead(t, {k}) OVER win' for k in range(1, n))} AS g "
    f"FROM (SELECT {_KEY}, unnest({c}) AS t, generate_subscripts({c}, 1) AS pos FROM tok) WINDOW win AS (PARTITION BY {_KEY} ORDER BY pos)"
    for c in ("pb", "rb") for n in range(1, 5))


@register("m5_bleu_treebank", f"""WITH pairs AS MATERIALIZED (SELECT * FROM {_BOTH_PAIRS_SQL}),
{_abbreviation_ctes("(SELECT ref AS text FROM pairs)")},
tok AS MATERIALIZED (SELECT {_KEY}, {_treebank_sql('pred')} AS pb, {_treebank_sql('ref')} AS rb FROM pairs, known),
gr AS ({_TREEBANK_GRAMS_SQL}),
pg AS (SELECT {_KEY}, n, g, count(*) FILTER (WHERE side = 'pb') AS cp, count(*) FILTER (WHERE side = 'rb') AS cr FROM gr WHERE g IS NOT NULL GROUP BY ALL),
cl AS (SELECT {_KEY}, {", ".join(f"sum(least(cp, cr)) FILTER (WHERE n = {n}) AS b{n}" for n in range(1, 5))} FROM pg GROUP BY ALL),
sc AS (SELECT t.*, {", ".join(f"coalesce(b{n}, 0) AS b{n}" for n in range(1, 5))} FROM tok t LEFT JOIN cl USING ({_KEY}))
SELECT {_KEY}, round({_BLEU_SQL}, 6) AS bleu FROM sc""")
def m5_bleu_treebank(spark, sf):
    """BLEU over Treebank tokens; abbreviations are learned from the references."""
    from ..operators.score_text import with_text_scores
    pairs = _text_pairs(spark, sf)
    known = pairs.withColumn("_known", tb.as_list(tb.learn_abbreviations(pairs, "ref")))
    scored = with_text_scores(known, F.col("pred"), F.col("ref"), metrics=["bleu"], tokens=lambda text: tb.treebank_tokens(text, F.col("_known")))
    return scored.select("model", "split", "shot", "identifier", r6(F.col("bleu")).alias("bleu"))


# =============================================================== M11 summary and reports



def _summary(spark, sf):
    from .evaluate import summarize_run
    return summarize_run(spark, fx.all_items(spark, sf), fx.all_responses(spark, sf), stem=False)  # SQL has no stemmer


def _summary_sql(rounded=_r6_sql) -> str:
    parts = [
        f"SELECT model, split, shot, accuracy FROM ({_acc_sql(rounded)})",
        f"SELECT model, split, shot, precision, recall, f1 FROM "
        f"({_f1_sql(ofx.tuple_responses(), ofx.tuple_items(), arity3=False, positional=False, rounded=rounded)})",
        f"SELECT model, split, shot, precision, recall, f1 FROM "
        f"({_f1_sql(ofx.triple_responses(), ofx.triple_items(), arity3=True, positional=True, rounded=rounded)})",
        f"SELECT model, split, shot, bleu, rouge1, rouge2, rougeL FROM ({_text_summary_sql(rounded)})",
    ]
    union = " UNION ALL BY NAME ".join(f"({p})" for p in parts)
    return f"""(SELECT 'local' AS dataset, u.split, u.model, './prompt/bench_' || u.split || '/' || u.shot || '.txt' AS prompt_path,
    u.shot, coalesce(c.task_type, 'mc') AS task_type, {", ".join("CAST(u." + m + " AS DOUBLE) AS " + m for m in _METRICS)}
  FROM ({union}) u LEFT JOIN {cat.catalog_values_sql()} c ON u.split = c.split)"""


@register("m11_summary", f"SELECT * FROM {_summary_sql()}")
def m11_summary(spark, sf):
    s = _summary(spark, sf)
    return s.select(*[r6(F.col(c)).alias(c) if c in _METRICS else F.col(c) for c in s.columns])


_HEADLINE_SQL = f"""(SELECT s.model, s.split, s.shot, c.task_id, c.capability, c.metric,
    CASE WHEN c.metric = 'Accuracy' THEN s.accuracy WHEN c.metric = 'ROUGE-L' THEN s.rougeL
         WHEN c.metric IN ('Triple-F1', 'Tuple-F1') THEN s.f1 END AS headline
  FROM {_summary_sql()} s LEFT JOIN {cat.catalog_values_sql()} c ON s.split = c.split)"""


_GRID: dict[tuple[str, str], str] = {}


def _stored_grid(spark, sf) -> str:
    """The folder of stored sums of the whole grid, a run for each model; scored once in an application."""
    from ..session import scratch_path, store
    from .evaluate import with_gold
    from .partials import add_run, write_sizes
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRID:
        path = scratch_path(spark, "grid_sums")
        items, responses = store(with_gold(spark, fx.all_items(spark, sf)), "grid_items"), fx.all_responses(spark, sf)
        write_sizes(items, path)
        repeated = pr.repeated_sides(items, responses)  # keys have the model: one look serves both runs
        add_run(spark, items, responses.where("model = 'org/model-0'"), path, "model-0", stem=False, repeated=repeated)
        add_run(spark, items, responses.where("model <> 'org/model-0'"), path, "others", stem=False, repeated=repeated)
        _GRID[key] = path
    return _GRID[key]


@register("m11_stored", f"SELECT * FROM {_summary_sql()}")
def m11_stored(spark, sf):
    """M11 from the stored sums of two runs."""
    from .partials import stored_summary
    s = stored_summary(spark, _stored_grid(spark, sf))
    return s.select(*[r6(F.col(c)).alias(c) if c in _METRICS else F.col(c) for c in s.columns])


def _heads(spark, sf):
    """Headlines from the stored summary as reported (metrics rounded to 6 decimals, as in m11_summary)."""
    from .report import headline
    return headline(spark, m11_stored(spark, sf))


@register("rp1_headline", f"SELECT model, split, shot, task_id, capability, metric, round(headline, 6) AS headline FROM {_HEADLINE_SQL}")
def rp1_headline(spark, sf):
    h = _heads(spark, sf)
    return h.select("model", "split", "shot", "task_id", "capability", "metric", r6(F.col("headline")).alias("headline"))


@register("rp2_capability_rollup", f"""
SELECT model, shot, capability, split,
  CASE GROUPING(capability, split) WHEN 0 THEN 'split' WHEN 1 THEN 'capability' ELSE 'overall' END AS level,
  CAST(sum(CAST(floor(headline * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9 AS mean_headline, count(*) AS n
FROM {_HEADLINE_SQL} GROUP BY model, shot, ROLLUP(capability, split)""")
def rp2_capability_rollup(spark, sf):
    from .report import capability_rollup
    # headlines in exact integer nano-units, so the mean does not depend on summation order
    h = _heads(spark, sf).withColumn("headline", F.floor(F.col("headline") * 1e9).cast("bigint"))
    r = capability_rollup(h).withColumn("mean_headline", F.col("mean_headline") / 1e9)
    # exact integer sums divided once: equal in any engine, so no rounding is needed
    return r.select("model", "shot", "capability", "split", "level", "mean_headline", "n")


@register("rp3_shot_pivot", f"""
SELECT model, split,
  round(max(headline) FILTER (WHERE shot = 'zero_shot'), 6) AS zero_shot,
  round(max(headline) FILTER (WHERE shot = 'two_shot'), 6) AS two_shot,
  round(max(headline) FILTER (WHERE shot = 'four_shot'), 6) AS four_shot
FROM {_HEADLINE_SQL} GROUP BY model, split""")
def rp3_shot_pivot(spark, sf):
    from .report import shot_pivot
    p = shot_pivot(_heads(spark, sf))
    return p.select("model", "split", *[r6(F.col(c)).alias(c) for c in ("zero_shot", "two_shot", "four_shot")])


@register("rp4_leaderboard", f"""
SELECT model, split, shot, headline, rank() OVER (PARTITION BY split, shot ORDER BY headline DESC) AS rank
FROM (SELECT model, split, shot, round(headline, 6) AS headline FROM {_HEADLINE_SQL})""")
def rp4_leaderboard(spark, sf):
    from .report import leaderboard
    h = _heads(spark, sf).withColumn("headline", r6(F.col("headline")))
    return leaderboard(h).select("model", "split", "shot", "headline", F.col("rank").cast("bigint").alias("rank"))


@register("rp5_latest_run", f"""
SELECT model, split, shot, max_by(timestamp, timestamp) AS timestamp, round(max_by(accuracy, timestamp), 6) AS accuracy,
  max_by(event_id, timestamp) AS event_id, count(*) AS n_runs
FROM {ofx.run_history()} GROUP BY ALL""")
def rp5_latest_run(spark, sf):
    from .report import latest_runs
    r = latest_runs(fx.run_history(spark, sf))
    return r.select("model", "split", "shot", "timestamp", r6(F.col("accuracy")).alias("accuracy"), "event_id", "n_runs")


@register("rp6_missing_cells", f"""
WITH h AS {ofx.run_history()},
g AS (SELECT DISTINCT model, sp.split, sh.shot FROM h
      CROSS JOIN (SELECT unnest({ofx.SPLITS_LIST}) AS split) sp CROSS JOIN (SELECT unnest({ofx.SHOTS_LIST}) AS shot) sh)
SELECT model, split, shot FROM g WHERE NOT EXISTS
  (SELECT 1 FROM h WHERE h.model = g.model AND h.split = g.split AND h.shot = g.shot)""")
def rp6_missing_cells(spark, sf):
    from .report import missing_cells
    return missing_cells(fx.run_history(spark, sf))


@register("rp7_split_sizes", f"SELECT split, count(*) AS n_items FROM {ofx.all_items()} GROUP BY split")
def rp7_split_sizes(spark, sf):
    from .report import split_sizes
    return split_sizes(fx.all_items(spark, sf))


# =============================================================== S8 run grid

@register("s8_run_grid", f"""
SELECT 'local' AS dataset, model, sp.split, sh.shot, './prompt/bench_' || sp.split || '/' || sh.shot || '.txt' AS prompt_path,
  8192 AS max_batched_tokens, CASE WHEN sp.split LIKE '3\\_%' ESCAPE '\\' THEN 512 ELSE 128 END AS max_tokens,
  0.0 AS temperature, 1.0 AS top_p
FROM (SELECT DISTINCT model FROM {ofx.all_responses()}) m
  CROSS JOIN (SELECT unnest({ofx.SPLITS_LIST}) AS split) sp CROSS JOIN (SELECT unnest({ofx.SHOTS_LIST}) AS shot) sh""")
def s8_run_grid(spark, sf):
    from .grid import run_grid
    return run_grid(fx.all_responses(spark, sf).select("model"))


# =============================================================== S1 / S2 item sources

@register("s1_items", f"""
SELECT split, ord, identifier, id, length(question) AS question_chars, options IS NULL AS no_options, length(answer) AS answer_chars
FROM {ofx.all_items()}""")
def s1_items(spark, sf):
    from ..session import scratch_path
    from ..sources.items import read_items, write_items
    path = scratch_path(spark, "s1_items")
    write_items(fx.all_items(spark, sf), path, fmt="json")
    it = read_items(spark, path, fmt="json")
    return it.select("split", "ord", "identifier", "id", F.length("question").alias("question_chars"),
                     F.col("options").isNull().alias("no_options"), F.length("answer").alias("answer_chars"))


@register("s1_rejects", f"""
SELECT source, reason, count(*) AS n, CAST(sum(mark) AS BIGINT) AS marks FROM (
  SELECT 'items' AS source, CASE WHEN ord % 17 = 0 THEN {ofx.sql_str(rj.MALFORMED)} WHEN ord % 19 = 3 THEN 'no answer' ELSE 'accepted' END AS reason,
    CASE WHEN ord % 17 = 0 THEN 0 ELSE ord END AS mark FROM {ofx.all_items()}
  UNION ALL
  SELECT 'runs', CASE WHEN max_batched_tokens <= 0 THEN {ofx.sql_str(pm.BAD_BATCHED_TOKENS)} WHEN max_tokens <= 0 THEN {ofx.sql_str(pm.BAD_MAX_TOKENS)}
      WHEN temperature < 0 THEN {ofx.sql_str(pm.BAD_TEMPERATURE)} WHEN NOT (top_p >= 0 AND top_p <= 1) THEN {ofx.sql_str(pm.BAD_TOP_P)}
      WHEN l_orderkey % 5 = 0 THEN {ofx.sql_str(rj.NO_SHOT)} ELSE 'accepted' END, l_linenumber
  FROM {ofx.run_configs()})
GROUP BY 1, 2""")
def s1_rejects(spark, sf):
    """Item lines, some cut short or without an answer, and run configs, some invalid or with a prompt path that has no shot label."""
    from ..session import scratch_path
    items = fx.all_items(spark, sf).withColumn("answer", F.when(F.col("ord") % 19 != 3, F.col("answer")))
    line = F.to_json(F.struct("split", "ord", "identifier", "id", "options", "answer", "question"))
    lines, kept, runs_kept = (scratch_path(spark, name) for name in ("s1_lines", "s1_checked", "s1_runs"))
    items.select(F.when(F.col("ord") % 17 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(lines)
    rj.store_checked(rj.read_items_checked(spark, lines), kept)
    runs = fx.run_configs(spark, sf).withColumn("prompt_path", F.when(F.col("l_orderkey") % 5 == 0, "few.txt").otherwise("two_shot.txt"))
    rj.store_checked(runs.withColumn("reason", rj.run_reject_reason(runs, tx.shot_label(F.col("prompt_path")))), runs_kept)

    def told(path, source, mark):
        # of a line that doesn't parse no field is certain
        by_row = F.when(F.col("reason") == rj.MALFORMED, F.lit(0)).otherwise(F.get_json_object("record", f"$.{mark}").cast("long"))
        return rj.read_accepted(spark, path).select(F.lit(source).alias("source"), F.lit("accepted").alias("reason"), F.col(mark).cast("long").alias("mark")
                                                    ).unionByName(rj.read_rejects(spark, path, source).select("source", "reason", by_row.alias("mark")))

    rows = told(kept, "items", "ord").unionByName(told(runs_kept, "runs", "l_linenumber"))
    return rows.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("marks"))


@register("s2_split_select", f"""
SELECT split, ord, identifier FROM {ofx.all_items()}
WHERE split = (SELECT max(split) FROM (SELECT DISTINCT split FROM {ofx.all_items()}) WHERE contains(split, '1_'))""")
def s2_split_select(spark, sf):
    from ..sources.items import select_split
    return select_split(fx.all_items(spark, sf), "1_", mode="reference").select("split", "ord", "identifier")


# =============================================================== S3 / S4 prompt files, P3 assembly

def _corpus_sql() -> str:
    mcq = "((split LIKE '%1\\_%' ESCAPE '\\' OR split LIKE '%2\\_%' ESCAPE '\\') AND split <> '2_5')"
    opts = q.strip("coalesce(options, '')")
    block = (f"'Question: ' || {q.strip('question')} || chr(10) || "
             f"CASE WHEN {mcq} THEN replace({opts}, chr(10) || chr(10), chr(10)) || chr(10) ELSE '' END"
             f" || 'Answer: ' || {q.strip('answer')} || chr(10) || chr(10)")
    return f"""(WITH top AS (SELECT split, ord, {block} AS b, row_number() OVER (PARTITION BY split ORDER BY ord) AS rn
                FROM {ofx.all_items()} QUALIFY rn <= 4)
  SELECT t.split, ['zero_shot', 'one_shot', 'two_shot', 'three_shot', 'four_shot'][k + 1] AS shot,
    CASE WHEN k = 0 THEN 'Answer the question of task ' || t.split || '.' || chr(10) || chr(10)
         ELSE string_agg(b, '' ORDER BY rn) FILTER (WHERE rn <= k) END
    || '|||' || chr(10) || 'Question: {{}}' || chr(10) || 'Answer:' || chr(10) AS text
  FROM top t CROSS JOIN range(5) AS kk(k) GROUP BY t.split, k)"""


def _parse_sql(text: str) -> str:
    raw = q.strip(text)
    parts = f"string_split({raw}, '|||')"
    return (f"len({parts}) AS n_parts, CASE WHEN len({parts}) = 2 THEN {parts}[1] END AS examples, "
            f"CASE WHEN len({parts}) = 2 THEN {parts}[2] END AS template, "
            f"(len({parts}) = 2 AND {q.strip(parts + '[1]')} <> '' AND {q.strip(parts + '[2]')} <> '') AS valid")


@register("s3_prompt_parse", f"""
SELECT 'corpus' AS source, split || '/' || shot AS key, {_parse_sql('text')} FROM {_corpus_sql()}
UNION ALL
SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, {_parse_sql('text')} FROM documents""")
def s3_prompt_parse(spark, sf):
    from ..sources.prompts import build_prompt_corpus, parse_prompts
    corpus = build_prompt_corpus(fx.all_items(spark, sf)).select(
        F.lit("corpus").alias("source"), F.concat_ws("/", "split", "shot").alias("key"), "text")
    docs = fx.table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("key"), "text")
    p = parse_prompts(corpus.unionByName(docs))
    return p.select("source", "key", F.col("n_parts").cast("bigint").alias("n_parts"), "examples", "template", "valid")


@register("s4_prompt_catalog", f"SELECT split, shot, {_parse_sql('text')} FROM {_corpus_sql()}")
def s4_prompt_catalog(spark, sf):
    from ..session import scratch_path
    from ..sources.prompts import build_prompt_corpus, read_prompt_corpus, write_prompt_corpus
    root = scratch_path(spark, "s4_prompts")
    write_prompt_corpus(build_prompt_corpus(fx.all_items(spark, sf)), root)
    c = read_prompt_corpus(spark, root)
    return c.select("split", "shot", F.col("n_parts").cast("bigint").alias("n_parts"), "examples", "template", "valid")


@register("p3_prompt", f"""
WITH c AS (SELECT split, shot, {_parse_sql('text')} FROM {_corpus_sql()}),
it AS (SELECT * FROM {ofx.mc_items()} UNION ALL SELECT * FROM {ofx.bool_items()})
SELECT it.split, c.shot, coalesce(it.identifier, it.id, 'example_' || it.ord) AS identifier,
  c.examples || replace(c.template, '{{}}', b.question_block) AS prompt
FROM it JOIN ({_block_sql(f"(SELECT split, coalesce(identifier, id, 'example_' || ord) AS identifier, question, options FROM (SELECT * FROM {ofx.mc_items()} UNION ALL SELECT * FROM {ofx.bool_items()}))")}) b
  ON b.split = it.split AND b.identifier = coalesce(it.identifier, it.id, 'example_' || it.ord)
JOIN c ON c.split = it.split AND c.valid AND c.shot IN ('zero_shot', 'two_shot', 'four_shot')""")
def p3_prompt(spark, sf):
    from ..catalog import GRID_SHOTS
    from ..operators.prompting import prompts_for
    from ..session import scratch_path
    from ..sources.prompts import build_prompt_corpus, read_prompt_corpus, write_prompt_corpus
    items = pr.resolve_identifier(fx.mc_items(spark, sf).unionByName(fx.bool_items(spark, sf)))
    root = scratch_path(spark, "p3_prompts")
    write_prompt_corpus(build_prompt_corpus(fx.all_items(spark, sf)), root)
    corpus = read_prompt_corpus(spark, root).where(F.col("shot").isin(*GRID_SHOTS))
    return prompts_for(items, corpus).select("split", "shot", "identifier", "prompt")


# =============================================================== S6 / S7 sinks (round trips)

def _details_sql() -> str:
    closed = "CASE WHEN r.split = '2_5' THEN " + q.e2("r.text") + " ELSE " + q.e1("r.text") + " END"
    tup = q.cascade(q.strip("r.text"))
    tri = f"list_filter({tup}, lambda t: len(t) = 3)"
    return f"""(SELECT r.model, r.split, r.shot, i.identifier, i.ord,
    CASE WHEN c.task_type IN ('mc', 'bool') THEN {closed} WHEN c.task_type = 'open_text' THEN {q.strip('r.text')} END AS pred_text,
    CASE WHEN c.task_type = 'open_triple' THEN len({tri}) WHEN c.task_type = 'open_tuple' THEN len({tup}) END AS n_pred_tuples,
    CASE WHEN c.task_type IN ('mc', 'bool') THEN coalesce(({closed}) = {q.strip('i.answer')}, false) END AS match,
    CAST(greatest(coalesce(len(r.token_ids), 0), 1) AS BIGINT) AS token_count, r.cumulative_logprob AS log_probability,
    coalesce(i.options, '') AS options
  FROM {ofx.all_responses()} r
  JOIN (SELECT split, ord, coalesce(identifier, id, 'example_' || ord) AS identifier, options, answer FROM {ofx.all_items()}) i
    ON r.split = i.split AND r.identifier = i.identifier
  LEFT JOIN {cat.catalog_values_sql()} c ON r.split = c.split)"""


@register("s6_detail", f"""
SELECT model, split, shot, identifier, ord, pred_text, CAST(n_pred_tuples AS INTEGER) AS n_pred_tuples, match, token_count,
  log_probability, options FROM {_details_sql()}""")
def s6_detail(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import read_details, write_details
    from .evaluate import extract
    e = extract(spark, fx.all_items(spark, sf), fx.all_responses(spark, sf), by_cell=True)
    details = e.select("identifier", "question", F.coalesce("options", F.lit("")).alias("options"), "response", "answer",
                       "pred_text", "pred_tuples", "log_probability", "token_count", "match", "ord", "model", "split", "shot")
    path = scratch_path(spark, "s6_details")
    write_details(details, path, compression="gzip", dealt=True)  # question, answer and field names of every line repeat over models and shots
    d = read_details(spark, path)
    return d.select("model", "split", "shot", "identifier", "ord", "pred_text", F.size("pred_tuples").alias("n_pred_tuples"),
                    "match", "token_count", "log_probability", "options").withColumn(
        "n_pred_tuples", F.when(F.col("n_pred_tuples") >= 0, F.col("n_pred_tuples")))


@register("o1_detail_order", f"""
SELECT model, split, shot, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM {_details_sql()}
WHERE split IN ('1_1', '2_5', '3_5') GROUP BY ALL""")
def o1_detail_order(spark, sf):
    """The order of the written detail rows: how often a line's ``ord`` is below that of the line before it in its file."""
    from pyspark.sql.window import Window

    from ..session import scratch_path
    from ..sources.sinks import read_details, write_details
    from .evaluate import extract
    some = F.col("split").isin("1_1", "2_5", "3_5")  # a choice, a boolean and a tuple task
    e = extract(spark, fx.all_items(spark, sf).where(some), fx.all_responses(spark, sf).where(some), by_cell=True)
    path = scratch_path(spark, "o1_details")
    write_details(e.select("identifier", "question", F.coalesce("options", F.lit("")).alias("options"), "response", "answer", "pred_text", "pred_tuples",
                           "log_probability", "token_count", "match", "ord", "model", "split", "shot"), path, compression="gzip", dealt=True)
    # a file is read from its start in blocks; within a block ids grow line by line
    lines = read_details(spark, path).select("model", "split", "shot", "ord", F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    before = F.lag("ord").over(Window.partitionBy("file").orderBy("block", "line"))  # files hold a bounded number of lines
    return lines.withColumn("before", before).groupBy("model", "split", "shot").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("before") > F.col("ord"), 1).otherwise(0)).cast("bigint").alias("n_out_of_order"))


def _fmt4_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE printf('%.4f', {x}) END"


def _summary_text_sql(n_appends: int) -> str:
    """The summary as its file has it: four decimals of the unrounded metrics."""
    return f"""SELECT dataset, split, model, prompt_path, task_type, {", ".join(_fmt4_sql(m) + " AS " + m for m in _METRICS)},
  CAST({n_appends} AS BIGINT) AS n_appends FROM {_summary_sql(str)}"""


_SUMMARY_KEYS = ["dataset", "split", "model", "prompt_path", "task_type", *_METRICS]


@register("s7_summary", _summary_text_sql(2))
def s7_summary(spark, sf):
    from ..session import scratch_path, store
    from ..sources.sinks import append_summary, read_summary
    s = store(_summary(spark, sf), "s7_rows")  # read by both appends
    path = scratch_path(spark, "s7_summary")
    append_summary(s, path)
    append_summary(s, path)
    return read_summary(spark, path).groupBy(*_SUMMARY_KEYS).agg(F.count(F.lit(1)).alias("n_appends"))


# =============================================================== streaming S7

@register("s7_summary_stream", _summary_text_sql(1))
def s7_summary_stream(spark, sf):
    """Responses land as three parquet drops, each a part of every cell; the stream scores them one by one and the summary is one row a cell.

    Rows are dealt in turn to partitions, of which every third makes a drop, so that all tasks write and read one."""
    from ..session import scratch_path, store
    from ..sources.sinks import append_summary, read_summary
    from ..streaming.incremental import score_stream
    from .evaluate import with_gold
    from .partials import stored_summary
    drop, sums, out, ckpt = (scratch_path(spark, n) for n in ("stream_in", "stream_sums", "stream_summary", "stream_ckpt"))
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    items = store(with_gold(spark, fx.all_items(spark, sf)), "stream_items")
    made = store(fx.all_responses(spark, sf).repartition(3 * files).withColumn("_drop", F.spark_partition_id() % 3), "stream_made")
    for k in range(3):
        made.where(F.col("_drop") == k).drop("_drop").write.mode("append").parquet(drop)
        score_stream(spark, items, drop, sums, ckpt, stem=False)
    append_summary(stored_summary(spark, sums), out)
    return read_summary(spark, out).groupBy(*_SUMMARY_KEYS).agg(F.count(F.lit(1)).alias("n_appends"))


@register("m9_text_summary_stem", _text_summary_sql(stem=True))
def m9_text_summary_stem(spark, sf):
    from ..operators.score_text import text_scores, text_summary
    s = text_summary(text_scores(_text_pairs(spark, sf), stem=True))
    return s.select("model", "split", "shot", *[r6(F.col(c)).alias(c) for c in ("bleu", "rouge1", "rouge2", "rougeL")], "n_pairs")


@register("m11_summary_corrected")  # quirks fixed (SURVEY 2.11): no SQL twin of the corrected parsers
def m11_summary_corrected(spark, sf):
    """The whole-grid summary with ``mode="corrected"`` (cased booleans, letter choice, tuple spans)."""
    from .evaluate import summarize_run
    s = summarize_run(spark, fx.all_items(spark, sf), fx.all_responses(spark, sf), mode="corrected", stem=False)
    return s.select(*[r6(F.col(c)).alias(c) if c in _METRICS else F.col(c) for c in s.columns])

"""DuckDB SQL for the fixture bindings in ``plans/fixtures.py`` (oracle side).

Each function returns a parenthesised subquery over the pre-registered test-table views.
Same integer arithmetic as the Spark side; DuckDB list lambdas use 1-based indexes.
"""

from __future__ import annotations

from ..catalog import SPLITS
from ..functions.text import BLEU_TOKEN_PATTERN

NL = "chr(10)"
SHOTS_LIST = "['zero_shot', 'two_shot', 'four_shot']"
SPLITS_LIST = "[" + ", ".join(f"'{s}'" for s in SPLITS) + "]"
GRID = "CROSS JOIN range(3) AS mm(m) CROSS JOIN range(3) AS ss(s)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BLEU_PAT = sql_str(BLEU_TOKEN_PATTERN)

MC_IDENT = ("CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL "
            "WHEN p_partkey % 9 = 0 THEN NULL ELSE 'part-' || p_partkey END")
MC_ID = "CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE 'id-' || p_partkey END"
MC_RESOLVED = f"coalesce({MC_IDENT}, {MC_ID}, 'example_' || p_partkey)"


def mc_items() -> str:
    return f"""(SELECT ['1_1', '1_2', '1_3', '1_4', '1_5', '2_1', '2_2', '2_3', '2_4'][p_partkey % 9 + 1] AS split, CAST(p_partkey AS BIGINT) AS ord,
    {MC_IDENT} AS identifier, {MC_ID} AS id,
    (CASE WHEN p_partkey % 4 = 1 THEN '  ' ELSE '' END) || 'Which item is ' || p_name || '?'
      || (CASE WHEN p_partkey % 10 = 0 THEN ' {{x}}' ELSE '' END) AS question,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'A. ' || p_brand || {NL} || {NL} || 'B. ' || p_type || {NL}
      || 'C. size ' || p_size || {NL} || 'D. ' || p_name || {NL} END AS options,
    substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS answer
  FROM part)"""


def mc_responses() -> str:
    letter = "substr('ABCD', CAST((p_partkey % 4 + CASE WHEN (p_partkey + m + s) % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1)"
    text = (f"CASE (p_partkey * 7 + m * 3 + s) % 6 WHEN 0 THEN 'Answer: ' || {letter} "
            f"WHEN 1 THEN lower({letter}) || '.' WHEN 2 THEN 'The option is (' || {letter} || ')' "
            f"WHEN 3 THEN 'I think it is a bolt, so ' || {letter} WHEN 4 THEN 'none of these' ELSE {letter} END")
    return f"""(SELECT 'org/model-' || m AS model, ['1_1', '1_2', '1_3', '1_4', '1_5', '2_1', '2_2', '2_3', '2_4'][p_partkey % 9 + 1] AS split,
    {SHOTS_LIST}[s + 1] AS shot,
    CASE WHEN (p_partkey + m + s) % 23 = 0 THEN {MC_RESOLVED} || '#lost' ELSE {MC_RESOLVED} END AS identifier,
    CASE WHEN (p_partkey + s) % 8 = 0 THEN '  ' || ({text}) || {NL} ELSE {text} END AS text,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE -CAST(p_partkey % 50 AS DOUBLE) / 10 - m END AS cumulative_logprob,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST([] AS INTEGER[])
      ELSE CAST(range(1, p_size + 1) AS INTEGER[]) END AS token_ids
  FROM part {GRID})"""


def repeated_items() -> str:
    return f"""(SELECT * FROM {mc_items()} UNION ALL
    SELECT split, ord + 1000000000 AS ord, identifier, id, question, options, 'Z' AS answer FROM {mc_items()} WHERE ord % 7 = 0)"""


def repeated_responses() -> str:
    number = "CAST(regexp_extract(identifier, '([0-9]+)', 1) AS BIGINT)"
    return f"""(SELECT model, split, shot, identifier, text, {number} AS response_no FROM {mc_responses()} UNION ALL
    SELECT model, split, shot, identifier, CASE WHEN {number} % 2 = 0 THEN 'Z' ELSE text END, {number} + 1000000000
    FROM {mc_responses()} WHERE {number} % 5 = 0)"""


def numbered_responses() -> str:
    return f"""(SELECT 'org/model-' || m AS model,
    ['1_1', '1_2', '1_3', '1_4', '1_5', '2_1', '2_2', '2_3', '2_4'][p_partkey % 9 + 1] AS split,
    {SHOTS_LIST}[s + 1] AS shot, substr('ABCD', CAST((p_partkey + m) % 4 + 1 AS INT), 1) AS text, CAST(p_partkey AS BIGINT) AS request_id
  FROM part {GRID})"""


def bool_items() -> str:
    return """(SELECT '2_5' AS split, CAST(o_orderkey AS BIGINT) AS ord, 'order-' || o_orderkey AS identifier,
    CAST(NULL AS VARCHAR) AS id, 'Is order ' || o_orderkey || ' satisfiable?' AS question,
    CAST(NULL AS VARCHAR) AS options,
    CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'False' END AS answer
  FROM orders)"""


def bool_responses() -> str:
    truth = "((o_totalprice > 250000) <> ((o_orderkey + m + s) % 5 = 0))"
    word = f"(CASE WHEN {truth} THEN 'True' ELSE 'False' END)"
    text = (f"CASE (o_orderkey + m + s) % 4 WHEN 0 THEN 'It is ' || upper({word}) || '.' "
            f"WHEN 1 THEN lower({word}) WHEN 2 THEN 'Satisfiable: ' || {word} ELSE 'Cannot decide' END")
    return f"""(SELECT 'org/model-' || m AS model, '2_5' AS split, {SHOTS_LIST}[s + 1] AS shot,
    'order-' || o_orderkey AS identifier, {text} AS text,
    CAST(NULL AS DOUBLE) AS cumulative_logprob, CAST(NULL AS INTEGER[]) AS token_ids
  FROM orders {GRID})"""


LINE = "'(order_' || l_orderkey || ', contains, part_' || l_partkey || ')'"
LINE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def triple_items() -> str:
    return f"""(SELECT '3_' || (2 + l_orderkey % 3) AS split, CAST(l_orderkey AS BIGINT) AS ord,
    'order-' || l_orderkey AS identifier, CAST(NULL AS VARCHAR) AS id,
    'List the parts of order ' || l_orderkey || ' as triples.' AS question, CAST(NULL AS VARCHAR) AS options,
    string_agg({LINE}, {NL} {LINE_ORDER}) AS answer
  FROM lineitem GROUP BY l_orderkey)"""


def triple_responses() -> str:
    keep = "(l_partkey + m + s) % 5 <> 0"
    def agg(sep):
        return f"coalesce(string_agg({LINE}, {sep} {LINE_ORDER}) FILTER (WHERE {keep}), '')"
    return f"""(SELECT 'org/model-' || m AS model, '3_' || (2 + l_orderkey % 3) AS split, {SHOTS_LIST}[s + 1] AS shot,
    'order-' || l_orderkey AS identifier,
    CASE (l_orderkey + m + s) % 3 WHEN 0 THEN {agg(NL)}
      WHEN 1 THEN 'Triples: ' || {agg("' '")} || '.'
      ELSE '[' || {agg("', '")} || ']' END AS text,
    CAST(NULL AS DOUBLE) AS cumulative_logprob, CAST(NULL AS INTEGER[]) AS token_ids
  FROM lineitem {GRID} GROUP BY l_orderkey, m, s)"""


LOT = "CASE WHEN l_suppkey % 2 = 0 THEN 'part_' || l_partkey ELSE 'part_' || l_partkey || ', lot ' || l_suppkey END"
NAMED_LINE = ("'(order_' || l_orderkey || ', ' || CASE l_linenumber % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'contains, in part' "
              f"ELSE 'contains, in part, late' END || ', ' || {LOT} || ')'")


def named_items() -> str:
    """With the list of listed names."""
    return f"""(SELECT '3_' || (2 + l_orderkey % 3) AS split, CAST(l_orderkey AS BIGINT) AS ord, 'named-' || l_orderkey AS identifier,
    list_distinct(list({LOT}) || ['order_' || l_orderkey, 'contains', 'contains, in part', 'contains, in part, late']) AS names,
    string_agg({NAMED_LINE}, {NL} ORDER BY l_linenumber, l_partkey, l_suppkey) AS answer
  FROM lineitem GROUP BY l_orderkey)"""


def named_responses() -> str:
    def agg(sep):
        return f"coalesce(string_agg({NAMED_LINE}, {sep} ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE (l_partkey + m + s) % 5 <> 0), '')"
    return f"""(SELECT 'org/model-' || m AS model, '3_' || (2 + l_orderkey % 3) AS split, {SHOTS_LIST}[s + 1] AS shot,
    'named-' || l_orderkey AS identifier,
    CASE (l_orderkey + m + s) % 3 WHEN 0 THEN {agg(NL)} WHEN 1 THEN 'Triples: ' || {agg("' '")} || '.' ELSE '[' || {agg("', '")} || ']' END AS text
  FROM lineitem {GRID} GROUP BY l_orderkey, m, s)"""


PAIR = "'(''' || s_name || ''', ''' || n_name || ''')'"


def _supplier_nation() -> str:
    return "(SELECT s_suppkey, s_name, s_nationkey, n_name, s_suppkey // 100 AS bucket FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def tuple_items() -> str:
    return f"""(SELECT '3_5' AS split, CAST(s_nationkey * 1000000 + bucket AS BIGINT) AS ord,
    'nation-' || s_nationkey || '-' || bucket AS identifier, CAST(NULL AS VARCHAR) AS id,
    'Align the suppliers of ' || any_value(n_name) || ' with their nation.' AS question, CAST(NULL AS VARCHAR) AS options,
    '[' || string_agg({PAIR}, ', ' ORDER BY s_suppkey) || ']' AS answer
  FROM {_supplier_nation()} GROUP BY s_nationkey, bucket)"""


def tuple_responses() -> str:
    # kept pairs, with those of key % 5 = 0 listed twice, in supplier order
    inner = f"""(SELECT m, s, s_nationkey, bucket, s_suppkey, rep, {PAIR} AS pair
      FROM {_supplier_nation()} CROSS JOIN range(3) AS mm(m) CROSS JOIN range(3) AS ss(s) CROSS JOIN range(2) AS rr(rep)
      WHERE (s_suppkey + s) % 3 <> m AND (rep = 0 OR s_suppkey % 5 = 0))"""
    def agg(sep):
        return f"coalesce(string_agg(pair, {sep} ORDER BY s_suppkey, rep), '')"
    grid = f"(SELECT DISTINCT s_nationkey, bucket, m, s FROM {_supplier_nation()} CROSS JOIN range(3) AS mm(m) CROSS JOIN range(3) AS ss(s))"
    return f"""(SELECT 'org/model-' || g.m AS model, '3_5' AS split, {SHOTS_LIST}[g.s + 1] AS shot,
    'nation-' || g.s_nationkey || '-' || g.bucket AS identifier,
    CASE (g.s_nationkey + g.m + g.s) % 3 WHEN 0 THEN '[' || {agg("', '")} || ']'
      WHEN 1 THEN {agg(NL)} ELSE {agg("', '")} END AS text,
    CAST(NULL AS DOUBLE) AS cumulative_logprob, CAST(NULL AS INTEGER[]) AS token_ids
  FROM {grid} g LEFT JOIN {inner} k ON g.s_nationkey = k.s_nationkey AND g.bucket = k.bucket AND g.m = k.m AND g.s = k.s
  GROUP BY g.s_nationkey, g.bucket, g.m, g.s)"""


def text_items() -> str:
    return """(SELECT '3_1' AS split, 1000000000000 + doc_id AS ord, 'doc-' || doc_id AS identifier,
    CAST(NULL AS VARCHAR) AS id, 'Define document ' || doc_id AS question, CAST(NULL AS VARCHAR) AS options,
    text AS answer FROM documents)"""


def text_responses() -> str:
    return f"""(SELECT 'org/model-' || m AS model, '3_1' AS split, 'zero_shot' AS shot, 'doc-' || doc_id AS identifier,
    array_to_string(list_filter(regexp_extract_all(lower(text), {BLEU_PAT}), lambda t, i: (i + m + doc_id) % (4 + m) <> 0), ' ') AS text,
    CAST(NULL AS DOUBLE) AS cumulative_logprob, CAST(NULL AS INTEGER[]) AS token_ids
  FROM documents CROSS JOIN range(3) AS mm(m))"""


def conversation_pairs() -> str:
    return """(SELECT 'org/model-0' AS model, '3_1' AS split, 'zero_shot' AS shot,
    'conv-' || u.conv_id || '-' || u.turn AS identifier, a.text AS pred, u.text AS ref
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def conversation_items() -> str:
    return """(SELECT '3_1' AS split, CAST(conv_id * 100 + turn AS BIGINT) AS ord, 'conv-' || conv_id || '-' || turn AS identifier,
    CAST(NULL AS VARCHAR) AS id, 'Continue conversation ' || conv_id AS question, CAST(NULL AS VARCHAR) AS options,
    text AS answer FROM conversations WHERE role = 'user')"""


def conversation_responses() -> str:
    return """(SELECT 'org/model-0' AS model, '3_1' AS split, 'zero_shot' AS shot, 'conv-' || conv_id || '-' || (turn - 1) AS identifier,
    text, CAST(NULL AS DOUBLE) AS cumulative_logprob, CAST(NULL AS INTEGER[]) AS token_ids
  FROM conversations WHERE role = 'assistant')"""


def run_history() -> str:
    split = f"{SPLITS_LIST}[CAST(event_id % 15 + 1 AS INT)]"
    return f"""(SELECT 'org/model-' || (user_id % 17) AS model,
    CASE WHEN user_id % 17 IN (3, 4, 8, 9) AND {split} = '3_4' THEN '3_2' ELSE {split} END AS split,
    {SHOTS_LIST}[CAST((event_id // 15) % 3 + 1 AS INT)] AS shot,
    ts AS timestamp, value AS accuracy, event_id
  FROM events)"""


def run_configs() -> str:
    return """(SELECT l_orderkey, l_linenumber, 4096 * (l_linenumber % 3) AS max_batched_tokens,
    l_linenumber - 1 AS max_tokens, l_discount - 0.02 AS temperature, l_quantity / 40 AS top_p
  FROM lineitem)"""


def padded_documents() -> str:
    return f"""(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN chr(9) || text || {NL}
      WHEN 1 THEN '  ' || text || '  ' WHEN 2 THEN {NL} || {NL} || text || ' ' || chr(9)
      WHEN 3 THEN chr(28) || text || chr(31) ELSE text END AS text FROM documents)"""


def all_items() -> str:
    return "(" + " UNION ALL ".join(f"SELECT * FROM {f()}" for f in (mc_items, bool_items, triple_items, tuple_items, conversation_items, text_items)) + ")"


def all_responses() -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT * FROM {f()}" for f in (mc_responses, bool_responses, triple_responses, tuple_responses, conversation_responses, text_responses)
    ) + ")"

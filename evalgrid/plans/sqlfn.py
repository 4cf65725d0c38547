"""DuckDB expression builders that mirror the Spark column functions (oracle side only)."""

from __future__ import annotations

from ..functions.text import STRIP_PATTERN, WS_CLASS
from .oracle_fixtures import sql_str

STRIP = sql_str(STRIP_PATTERN)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def e1(raw: str) -> str:
    s = strip(raw)
    m = f"regexp_extract({s}, '\\b([A-D])\\b', 1, 'i')"
    return f"(CASE WHEN {m} <> '' THEN upper({m}) ELSE {s} END)"


def e2(raw: str) -> str:
    s = strip(raw)
    m = f"regexp_extract({s}, '\\b(true|false)\\b', 1, 'i')"
    return f"(CASE WHEN {m} <> '' THEN lower({m}) ELSE lower({s}) END)"


TUPLE_SPAN = sql_str(r"\(" + WS_CLASS + r"*([^\)]+?)" + WS_CLASS + r"*\)")
QUOTE_STRIP = sql_str(r"\A[ '\"]+|[ '\"]+\z")


def e5(stripped: str, mode: str = "reference") -> str:
    s = f"translate({stripped}, '[{{]}}', '(())')"
    if mode == "reference":
        s = f"regexp_replace(regexp_replace({s}, '^[\\(\\)]+', ''), '[\\(\\)]+$', '')"
    spans = f"regexp_extract_all({s}, {TUPLE_SPAN}, 1)"
    parts = (f"list_transform({spans}, lambda sp: list_transform(list_filter(string_split(sp, ','), "
             f"lambda p: {strip('p')} <> ''), lambda p: regexp_replace(p, {QUOTE_STRIP}, '', 'g')))")
    return f"list_filter({parts}, lambda t: len(t) >= 2)"


def e4(stripped: str) -> str:
    """Python-literal parse restricted to the fixture grammar: quoted-string tuples, optionally in a list.

    Valid exactly when the text, brackets and quotes converted to JSON and wrapped in one more
    list, parses as JSON; leaves are then the innermost parenthesised groups.
    """
    js = f"'[' || replace(replace(replace({stripped}, '(', '['), ')', ']'), '''', '\"') || ']'"
    leaves = f"regexp_extract_all({stripped}, '\\(([^()]*)\\)', 1)"
    parts = f"list_transform({leaves}, lambda l: list_transform(string_split(l, ','), lambda p: regexp_replace(trim(p), '\\A''|''\\z', '', 'g')))"
    return (f"(CASE WHEN {stripped} LIKE '%,%' AND json_valid({js}) "
            f"THEN list_filter({parts}, lambda t: len(t) >= 2) ELSE CAST([] AS VARCHAR[][]) END)")


def cascade(stripped: str, mode: str = "reference") -> str:
    a = e4(stripped)
    return f"(CASE WHEN len({a}) > 0 THEN {a} ELSE {e5(stripped, mode)} END)"


def render(tuples: str) -> str:
    return f"array_to_string(list_transform({tuples}, lambda t: '(' || array_to_string(t, '|') || ')'), '')"


def safe_div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


def f1(p: str, r: str) -> str:
    return safe_div(f"2.0 * ({p}) * ({r})", f"({p}) + ({r})")

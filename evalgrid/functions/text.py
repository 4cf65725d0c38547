"""Column -> Column text helpers, all JVM-side (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: character classes that mirror Python's str.strip()/str.isspace() ----
# Python's whitespace set: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.  Written with \x{..} escapes so
# the same class works in Java regexes (Spark) and RE2 (DuckDB oracle).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP_PATTERN = r"\A" + WS_CLASS + r"+|" + WS_CLASS + r"+\z"
# BLEU tokeniser (native stand-in for a Treebank word tokeniser): word runs or single symbols.
BLEU_TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\t\n\x0B\f\r \p{L}\p{N}_]"
# the same matches for Java's regexes, without steps back, and runs of ASCII without a look at Unicode's classes
BLEU_TOKEN_JAVA = r"[a-z0-9_]++(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++|[^\t\n\x0B\f\r \p{L}\p{N}_]"
# ROUGE tokeniser: lower-case, everything outside [a-z0-9] separates tokens.
ROUGE_TOKEN_PATTERN = r"[a-z0-9]+"
SHOT_LABEL_PATTERN = r"(?i)(zero|one|two|three|four)_shot"
# ---- end fixed values ----


# the same set as characters, for btrim (code-generated, touches only the two ends)
WS_CHARS = "".join(chr(x) for x in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` -- plain ``trim`` only removes spaces; ``btrim`` with Python's
    whitespace set is exact and, unlike a regex, only looks at the two ends of the string."""
    return F.btrim(c, F.lit(WS_CHARS))


def bleu_tokens(c: Column) -> Column:
    """Tokeniser A: lower-cased word runs and single punctuation marks."""
    return F.regexp_extract_all(F.lower(c), F.lit(BLEU_TOKEN_JAVA), 0)


def rouge_tokens(c: Column) -> Column:
    """Tokeniser B (no stemming): lower-case, split on anything outside [a-z0-9]."""
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_TOKEN_PATTERN), 0)


def model_safe(c: Column) -> Column:
    """Path-safe model name, '/' and '-' both become '_'."""
    return F.translate(c, "/-", "__")


def shot_label(path: Column) -> Column:
    """Shot label from the *basename* of a prompt path, case-insensitive; null when absent."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    label = F.regexp_extract(base, SHOT_LABEL_PATTERN, 1)
    return F.when(label != "", F.lower(label))


def fmt4(c: Column) -> Column:
    """P10: metric as 4-decimal text, rounded on the exact value of the double, half to even, as C's ``%.4f``.

    Java's formatter rounds the shortest decimal form half up, which differs on ties (0.03125) and on doubles
    just below a decimal tie.  Here ``over`` is the exact distance of 20,000 x from the odd number between two
    neighbours: the high part of x has at most 38 bits (x < 256), so its product is exact, and the low part's
    is too small to change the sign.  Only used in sinks; metrics stay DOUBLE inside.
    """
    x = F.abs(c)
    high = F.floor(x * 2**30) / 2**30
    low = F.floor(x * 10000)
    over = (high * 20000 - (2 * low + 1)) + (x - high) * 20000
    n = low + F.when(over > 0, 1).when(over == 0, low % 2).otherwise(0)
    text = F.format_string("%s%d.%04d", F.when(c < 0, "-").otherwise(""), F.floor(n / 10000), n % 10000)
    return F.when(c.isNotNull(), F.when(x < 256, text).otherwise(F.format_string("%.4f", c)))


def iso_timestamp(ts: Column | None = None) -> Column:
    """ISO-8601 run timestamp with microseconds (Python's ``datetime.isoformat``)."""
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

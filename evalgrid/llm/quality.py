"""Operator 5: quality rules by distribution divergence.  DataFrame functions only.

Base counts: words ([^\\x20\\x09-\\x0D]+), code points in words, symbols, repeated lines, and words in
8-word windows that occur twice in the text.  The method's verdict compares two histograms of a
document with references of its language, learned from the whole table: the shares of character
classes, and the shares of the language's ``TOP_WORDS`` commonest words (by number of documents; at most
``MAX_WORD`` code points, lower-cased) with one bin for all other words.  Distance is the Jensen-Shannon
distance; as short texts differ by chance, the allowed distance widens with 1/sqrt(n), and texts below a
minimum length fail the base rule.

A language is the letters before any region of ``lang``, lower-cased (``EN`` and ``en-US`` are ``en``); rows without
one (null, or no letter first) are one more language.  Every language has references, however few its documents:
those of a single document are its own shares, which it fits.

Two passes over the texts: word counts, then base counts and histograms.  Word counts are added up in each
task before they are shuffled by (language, word), and the commonest words of a language are chosen in each task
first, so a language that holds most rows is spread over all tasks.  References join by broadcast up to
``MAX_BROADCAST_LANGS`` languages (at most 2 KB each), by an ordinary join beyond that.

Windows are compared by 64-bit hash within one text.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; null ids and
languages stay; repeated rows are judged each; extra columns are passed on, but one named as a column that
``quality`` adds is replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.llm.common import ASCII_SPACE, cut, set_aside

# Fixed values of the contract.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
# Character classes of the histogram: lower-case and other letters, capitals, digits, sentence marks, other marks, space.
N_CLASSES = 6
TOP_WORDS = 20
MAX_WORD = 20
MAX_BROADCAST_LANGS = 4096
MAX_LITERAL_LANGS = 64
MAX_CHAR_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.55


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also when ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, chars: str) -> Column:
    """``text`` less these characters; one search for each is faster than a translation."""
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """Hash of the eight words from each place on, by doubling: pairs, fours, eights."""
    def pairs(h, step):
        return let(h, lambda x: F.when(F.size(x) > step, F.zip_with(
            F.slice(x, 1, F.size(x) - step), F.slice(x, 1 + step, F.size(x) - step), lambda a, b: F.xxhash64(a, b))).otherwise(
            F.array().cast("array<bigint>")))
    return pairs(pairs(pairs(words, 1), 2), 4)


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice: sort (hash, place), keep those with an equal neighbour,
    then add up the new words that each window covers in text order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    def twice(s):
        marked = F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["at"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))
    def steps(at):
        return F.aggregate(F.transform(at, lambda a, i: F.when(i == 0, WINDOW).otherwise(F.least(a - F.get(at, i - 1), F.lit(WINDOW)))),
                           F.lit(0), lambda total, n: total + n)
    return let(let(placed, twice), steps)


def _repeat_words(words: Column) -> Column:
    return let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))


def base_counts(docs: DataFrame, **of_words) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; and with a column
    for each function of the words in ``of_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dup_lines = let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
                    lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    counted = docs.withColumns({
        "_found": let(words_of(text), lambda w: F.struct(
            F.size(w).alias("n"), _repeat_words(w).alias("repeated"), *[use(w).alias(name) for name, use in of_words.items()])),
        "word_chars": F.length(without(text, ASCII_SPACE)).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": dup_lines.cast("long")})
    n, repeated = F.col("_found.n").cast("long"), F.col("_found.repeated").cast("long")
    return counted.withColumns({"n_words": n, "n_repeat_words": repeated, **{name: F.col(f"_found.{name}") for name in of_words},
                                "base_failed": (n < MIN_WORDS) | (100 * repeated > 30 * n)}).drop("_found")


def _class_counts(text: Column) -> Column:
    """Code points of each class; the text is scanned for capitals and for marks, and marks are told apart by themselves."""
    def counts(capitals, marks):
        digits = F.length(F.regexp_replace(marks, r"\P{N}+", ""))
        stops = F.length(F.regexp_replace(marks, r"[^.,;:!?'\"()-]+", ""))
        space = F.length(text) - F.col("word_chars")
        return F.array(F.col("word_chars") - capitals - F.length(marks), capitals, digits, stops, F.length(marks) - digits - stops, space)
    return let(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""), lambda marks: F.transform(
        counts(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), marks), lambda n: n.cast("double")))


def language_of(lang: Column) -> Column:
    """The language's letters, lower-cased; empty where there are none."""
    return F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^\s*(\p{L}+)", 1))


def common_words(docs: DataFrame, top_words: int = TOP_WORDS, max_word: int = MAX_WORD) -> DataFrame:
    """_lang, common: a language's words found in most of its documents, most frequent first, ties in order of the words."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    for space in "\t\n\x0b\x0c\r":  # then one character splits, which is faster than a class
        text = F.replace(text, F.lit(space), F.lit(" "))
    found = docs.select(language_of(F.col("lang")).alias("_lang"), F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    counted = found.where(F.length("word").between(1, max_word)).groupBy("_lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= top_words)
    return top.groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"))


def _with(rows: DataFrame, per_language: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``per_language``, a stored table of one row a language: broadcast if its rows are few."""
    few = per_language.count() <= MAX_BROADCAST_LANGS
    return rows.join(F.broadcast(per_language) if few else per_language, "_lang", "left")


def with_histograms(docs: DataFrame, common: DataFrame) -> DataFrame:
    """``docs`` with base counts, ``_lang``, and a distribution each in ``classes`` and ``shares``.  ``common``: common_words, stored.

    A word is looked up among its language's; where languages are few, those that are no language's go first, by a set."""
    own, every = F.coalesce("common", F.array().cast("array<string>")), None
    if common.count() <= MAX_LITERAL_LANGS:
        every = sorted(r.word for r in common.select(F.explode("common").alias("word")).distinct().collect())
    known = _with(docs.withColumn("_lang", language_of(F.col("lang"))), common)
    counted = base_counts(known, shares=lambda words: let(own, lambda c: _normal(_word_histogram(words, c, every))))
    return counted.withColumn("classes", _normal(_class_counts(F.coalesce(F.col("text"), F.lit(""))))).drop("common")  # reads word_chars


def language_references(scored: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """_lang, ref_classes, ref_shares: the mean distributions of a language's documents that pass the base rule, so each
    document weighs the same and a few long texts don't shape them."""
    means = [F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, size in (("classes", N_CLASSES), ("shares", top_words + 1)) for i in range(size)]

    def held(prefix, size):
        return F.filter(F.array(*[F.col(f"{prefix}{i}") for i in range(size)]), lambda x: x.isNotNull()).alias(f"ref_{prefix}")
    return scored.where(~F.col("base_failed")).groupBy("_lang").agg(*means).select(
        "_lang", held("classes", N_CLASSES), held("shares", top_words + 1))


def _word_histogram(words: Column, common: Column, every: list[str] | None) -> Column:
    """Counts of each of ``common``, then of all other words; only words of ``every``, if given, can be common."""
    def bins(h):
        return F.array_append(F.transform(common, lambda c: F.size(F.filter(h, lambda x: x == c)).cast("double")),
                              (F.size(words) - F.size(F.filter(h, lambda x: F.array_contains(common, x)))).cast("double"))
    kept = words if every is None else F.filter(words, lambda x: F.lower(x).isin(every))
    lowered = F.transform(kept, F.lower)
    return let(lowered if every is not None else F.filter(lowered, lambda x: F.array_contains(common, x)), bins)


def _normal(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x),
                                     lambda s: F.transform(c, lambda x: x / F.greatest(s, F.lit(1e-9)))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two distributions of one length."""
    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judge(scored: DataFrame, refs: DataFrame, max_char_distance: float = MAX_CHAR_DISTANCE,
          max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``scored`` (a stored table of with_histograms) plus char_distance, word_distance and kept.  ``refs``: language_references, stored."""
    joined = _with(scored, refs)
    slack = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    fits = (F.col("char_distance") <= max_char_distance + 0.5 * slack) & (F.col("word_distance") <= max_word_distance + slack)
    return (joined.withColumns({f"{kind}_distance": F.coalesce(js_distance(F.col(own), F.col(f"ref_{own}")), F.lit(0.0))
                                for kind, own in (("char", "classes"), ("word", "shares"))})
            .withColumn("kept", ~F.col("base_failed") & fits).drop("_lang", "ref_classes", "ref_shares", "classes", "shares"))


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with base counts, distances and kept."""
    common = cut(common_words(docs), "quality-words")
    scored = cut(with_histograms(set_aside(docs, "doc_id", "lang", "text"), common).drop("text"), "quality")
    judged = judge(scored, cut(language_references(scored), "quality-references"))
    added = [c for c in judged.columns if c not in ("doc_id", "lang", "_rest")]
    rest = [c for c in docs.columns if c not in ("doc_id", "lang", "text", *added)]
    return judged.select("doc_id", "lang", *[F.col("_rest").getField(c).alias(c) for c in rest], *added)

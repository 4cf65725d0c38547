"""Tokeniser A for BLEU (M5): sentences by learned abbreviations, then the Treebank word rules in each sentence.  All JVM-side.

Which words end in a period without ending a sentence is learned from the texts themselves (Kiss and Strunk, "Unsupervised multilingual
sentence boundary detection", 2006): one count of each word type with and without its period, a log-likelihood ratio of
the two hypotheses, and the paper's factors for short types, inner periods and occurrences without a period.

Texts are lower-cased first, as the metric does, so capitals are no evidence.  A sentence ends after a word that ends in a question or
exclamation mark, or in one period and is no learned abbreviation; closing quotes and brackets may follow.  Only a
sentence's last period is split from its word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS_CLASS, py_strip

# ---- fixed values: the Treebank rules for one sentence, in order (pattern, replacement) ----
RULES = [
    (r"([«“‘„]|[`]+)", r" \1 "),
    (r'^"', r"``"),
    (r"(``)", r" \1 "),
    (r"([ (\[{<])(\"|'')", r"\1 `` "),
    (r"'([a-ce-lo-ru-z0-9_])([^a-z0-9_]|$)", r"' \1\2"),
    (r"([^.])(\.)([\])}>\"'»”’ ]*) *$", r"\1 \2 \3 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*) *$", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", r" -- "),
    (r"^|$", r" "),
    (r"([»”’])", r" \1 "),
    (r"''", r" '' "),
    (r'"', r" '' "),
    (r" +", r" "),
    (r"([^' ])('s|'m|'d|') ", r"\1 \2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    (r"\b(can)(not)\b", r" \1 \2 "),
    (r"\b(d)('ye)\b", r" \1 \2 "),
    (r"\b(gim)(me)\b", r" \1 \2 "),
    (r"\b(gon)(na)\b", r" \1 \2 "),
    (r"\b(got)(ta)\b", r" \1 \2 "),
    (r"\b(lem)(me)\b", r" \1 \2 "),
    (r"\b(more)('n)\b", r" \1 \2 "),
    (r"\b(wan)(na) ", r" \1 \2 "),
    (r" ('t)(is)\b", r" \1 \2 "),
    (r" ('t)(was)\b", r" \1 \2 "),
]
# the places of the rules that can change a sentence of letters, digits, spaces, periods and commas only
PLAIN_PATTERN = r"^[\p{L}\p{N}_ .,]*$"
PLAIN_RULES = [5, 6, 7, 8, 10, 16, 20, 23, 25, 26, 27, 28, 30]
# what may follow the mark that ends a sentence, and what surrounds a word when types are counted
CLOSERS_PATTERN = r"[)\"'\]}>»”’]+$"
AROUND_PATTERN = r"^[(\"'\[{<«“‘„]+|[)\"'\]}>»”’,;:?!]+$"
# the paper's probability of a period after an abbreviation, and its threshold
ABBREVIATION_PERIOD, ABBREVIATION_SCORE = 0.99, 0.3
# ---- end fixed values ----

SPACES = WS_CLASS + "+"


def _words(text: Column) -> Column:
    return F.split(py_strip(F.lower(text)), SPACES)


def learn_abbreviations(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, score of the types that are abbreviations in ``texts``: one count by type, combined map-side, and its totals."""
    # equal words are counted first, so that each is taken apart once and not once for each time it occurs
    words = texts.select(F.explode(_words(F.col(column))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # empty ones have no count: a filter on words would be pushed below the first count, and the pattern with it
    words = words.select(F.regexp_replace("w", AROUND_PATTERN, "").alias("w"), "n").withColumn("n", F.when(F.col("w") != "", F.col("n")))
    ended = F.col("w").endswith(".") & ~F.col("w").endswith("..")
    typed = words.select(F.when(ended, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("word"), ended.alias("period"), "n")
    counts = typed.groupBy("word").agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("n_with"),
                                       F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("n_without"),
                                       F.bool_or(F.col("word").rlike(r"\p{L}")).alias("lettered"))
    total = counts.agg(F.sum("n_with").alias("p"), F.sum(F.col("n_with") + F.col("n_without")).alias("n"))
    share = total.select((F.col("p") / F.col("n")).alias("share")).scalar()
    found = counts.where("n_with > 0 AND lettered").withColumn("share", share).where("share < 1")
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    scored = found.withColumn("inner", inner).withColumn("letters", F.length("word") - inner)
    ratio = -2 * (F.col("n_with") * (F.log("share") - F.log(F.lit(ABBREVIATION_PERIOD)))
                  + F.col("n_without") * (F.log(1 - F.col("share")) - F.log(F.lit(1 - ABBREVIATION_PERIOD))))
    score = ratio * F.exp(-F.col("letters")) * (F.col("inner") + 1) * F.pow(F.col("letters"), -F.col("n_without"))
    return scored.select("word", score.alias("score")).where(F.col("score") >= ABBREVIATION_SCORE)


def as_list(abbreviations: DataFrame) -> Column:
    """The learned words as one array, read when the query runs.  Its size is bounded by the paper's length factor: a type of n letters needs
    a ratio above 0.3 e^n, so only short types qualify."""
    return abbreviations.agg(F.sort_array(F.collect_set("word")).alias("words")).scalar()


def sentences(text: Column, abbreviations: Column) -> Column:
    """The lower-cased sentences of a text, single spaces between words."""
    def mark(word):
        core = F.regexp_replace(word, CLOSERS_PATTERN, "")
        period = core.endswith(".") & ~core.endswith("..") & ~F.array_contains(abbreviations, F.regexp_replace(core, r"^[(\"'\[{<«“‘„]+|\.$", ""))
        marks = F.contains(word, F.lit(".")) | F.contains(word, F.lit("?")) | F.contains(word, F.lit("!"))
        return F.when(marks & (core.endswith("?") | core.endswith("!") | period), F.concat(word, F.lit("\n"))).otherwise(F.concat(word, F.lit(" ")))

    joined = F.array_join(F.transform(_words(text), mark), "")
    return F.filter(F.split(joined, "\n"), lambda s: F.length(F.btrim(s)) > 0)


def treebank_tokens(text: Column, abbreviations: Column) -> Column:
    """The tokens of all sentences in order."""
    def by(rules, sentence):
        s = F.btrim(sentence)
        for pattern, new in rules:
            s = F.regexp_replace(s, pattern, new.replace("\\", "$"))
        return F.split(F.btrim(s), " +")

    def tokens(sentence):
        return F.when(sentence.rlike(PLAIN_PATTERN), by([RULES[k] for k in PLAIN_RULES], sentence)).otherwise(by(RULES, sentence))

    found = F.flatten(F.transform(sentences(text, abbreviations), tokens))
    return F.filter(found, lambda t: t != "")

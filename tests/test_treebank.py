"""Tokeniser A: Treebank rules on sentences split by learned abbreviations; the stems' two forms."""

import random

from pyspark.sql import functions as F

from evalgrid.functions import stem as S
from evalgrid.functions import treebank as T


def test_words_split_as_documented(spark):
    cases = {
        "Good muffins cost $3.88 in New York.": ["good", "muffins", "cost", "$", "3.88", "in", "new", "york", "."],
        "I can't, won't and shouldn't've said \"they'll stay\".": ["i", "ca", "n't", ",", "wo", "n't", "and", "shouldn't", "'ve", "said", "``", "they",
                                                                  "'ll", "stay", "''", "."],
        "We saw Dr. Smith. He left!": ["we", "saw", "dr.", "smith", ".", "he", "left", "!"],
        "It's the dog's (old) bone -- isn't it?": ["it", "'s", "the", "dog", "'s", "(", "old", ")", "bone", "--", "is", "n't", "it", "?"],
        "gonna cannot 'tis wait... at 10:30, a@b; c*d": ["gon", "na", "can", "not", "'t", "is", "wait", "...", "at", "10:30", ",", "a", "@", "b", ";", "c", "*", "d"],
        "«Oui» [x] {y} 50% off": ["«", "oui", "»", "[", "x", "]", "{", "y", "}", "50", "%", "off"],
        "": [], "  \n ": [], ".": ["."],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "text string")
    got = {r.text: r.ts for r in df.select("text", T.treebank_tokens(F.col("text"), F.array(F.lit("dr"))).alias("ts")).collect()}
    assert got.pop(None) is None
    assert got == cases


def test_abbreviations_are_learned(spark):
    rng = random.Random(4)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    texts = []
    for _ in range(400):
        text = " ".join(rng.choices(words, k=8))
        texts.append(f"{text} Dr. {rng.choice(words)} met e.g. {rng.choice(words)} etc. and {rng.choice(words)}. The end no more.")
    texts += ["a no that no was no more no " * 30]
    got = {r.word for r in T.learn_abbreviations(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {"dr", "e.g", "etc"}
    none = spark.createDataFrame([], "text string")
    assert T.learn_abbreviations(none).count() == 0
    one = spark.createDataFrame([("No end. Dr. who",)], "text string")
    assert one.withColumn("k", T.as_list(T.learn_abbreviations(none))).select(T.treebank_tokens(F.col("text"), F.col("k"))).first()[0] == ["no", "end", ".", "dr", ".", "who"]


def test_both_stemmers_agree(spark):
    known = {"ties": "tie", "dies": "die", "flies": "fli", "spied": "spi", "died": "die", "enjoy": "enjoy", "say": "say", "happy": "happi", "sky": "sky",
             "skies": "sky", "conformably": "conform", "rationally": "ration", "geology": "geolog", "beautifully": "beauti", "inning": "inning",
             "aged": "age", "using": "use", "controlling": "control", "hopping": "hop", "falling": "fall"}
    assert {w: S.porter_stem(w, True) for w in known} == known
    rng = random.Random(1)
    ends = [s for s, _ in S.STEP2_EXTENDED + S.STEP3] + S.STEP4 + ["ed", "ing", "s", "ies", "ied", "eed", "y", "ll", "e", "sses", ""]
    words = {"".join(rng.choice("abcdeilosty2") for _ in range(rng.randint(0, 5))) + rng.choice(ends) + rng.choice(["", "", "ed", "ing", "s", "y", "li"])
             for _ in range(8000)} | set(known) | {"y" * n for n in range(1, 10)} | {"a" + "y" * n for n in range(9)} | {"b" + "y" * n for n in range(9)}
    words.discard("")
    got = S.stem_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()
    assert {r.word: r.stem for r in got} == {w: S.porter_stem(w, True) for w in words}


def test_plain_sentences_need_the_plain_rules_only():
    """The rules that are left out for sentences of letters, digits, spaces, periods and commas change none of them."""
    import random
    import re

    from evalgrid.functions.treebank import PLAIN_PATTERN, PLAIN_RULES, RULES

    def tokens(rules, s):
        s = s.strip(" ")
        for pattern, new in rules:
            s = re.sub(pattern, lambda m: re.sub(r"\\(\d)", lambda x: m.group(int(x[1])) or "", new), s)
        return [x for x in re.split(" +", s.strip(" ")) if x]

    draw = random.Random(3)
    words = ["cannot", "can", "not", "gimme", "gonna", "gotta", "lemme", "wanna", "wan", "na", "dye", "a", "1", "é", "x_y", ".", "..", "...", ",", "a.b",
             "1,2", "a,b", ",a", "more", "n", "tis", "twas", "t", "s", "e.g.", "end.", " ", "_"]
    for _ in range(20000):
        s = "".join(draw.choice(words) + draw.choice(["", " ", " ", ",", "."]) for _ in range(draw.randint(0, 7)))
        assert tokens(RULES, s) == tokens([RULES[k] for k in PLAIN_RULES], s), s
    assert r"\p{L}\p{N}_ .," in PLAIN_PATTERN


def test_learning_takes_each_distinct_word_apart_once(spark):
    """Words are counted before they are taken apart: the pattern stands above an aggregate in the plan."""
    from evalgrid.functions.treebank import learn_abbreviations

    texts = spark.createDataFrame([("dr. no and dr. no, (dr. no)",)], "text string")
    lines = learn_abbreviations(texts)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    taken_apart = [x for x in lines if "regexp_replace" in x]
    assert taken_apart and all("Aggregate [w#" in x for x in taken_apart)

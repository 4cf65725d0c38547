"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), with and without the extended rules.

Used by ROUGE with ``stem=True``: tokens longer than 3 characters are stemmed.  The extended rules are the ones a widely used
library adds to the published algorithm, some from Porter's own later programs: a short list of irregular words, -ied,
four-letter -ies, y after a single consonant, -bli, -alli, -fulli, -logi, and two-letter stems.

Two forms with equal results: ``porter_stem`` word by word, memoised, for the row-local text step; and ``stem_words``, which stems a table of
distinct words with SQL expressions alone (``stem_steps``).  The latter keep, beside the word, its letters' kinds as text
(``c`` consonant, ``v`` vowel): the measure of a stem is then the number of ``vc`` in it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

_VOWELS = frozenset("aeiou")


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return (len(w) >= 3 and _is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2)
            and _is_cons(w, len(w) - 1) and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    """Apply the first rule whose suffix matches (longest listed first); stop there."""
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# ---- fixed values: the algorithm's suffix tables, in the published order ----
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]
# the extended rules: irregular words with their stems, and the second step's table
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP2_EXTENDED = [(s, r) if s != "abli" else ("bli", "ble") for s, r in STEP2] + [("fulli", "ful")]
# ---- end fixed values ----


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[0]))


_STEP2 = _longest_first(STEP2)
_STEP2_EXTENDED = _longest_first(STEP2_EXTENDED)
_STEP3 = _longest_first(STEP3)
_STEP4 = sorted(STEP4, key=len, reverse=True)


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str, extended: bool = False) -> str:
    w = word
    if extended and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w

    def ends_cvc(stem: str) -> bool:
        return _cvc(stem) or (extended and len(stem) == 2 and not _is_cons(stem, 0) and _is_cons(stem, 1))

    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if extended and len(w) == 4 else w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    again = False
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and ends_cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and ((len(w) > 2 and _is_cons(w, len(w) - 2)) if extended else _has_vowel(w[:-1])):
        w = w[:-1] + "i"
    # steps 2 and 3
    if extended and w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if extended and w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _replace(w, _STEP2_EXTENDED if extended else _STEP2, lambda s: _measure(s) > 0)
    w = _replace(w, _STEP3, lambda s: _measure(s) > 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not ends_cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def rouge_stem_tokens(tokens: list[str]) -> list[str]:
    """ROUGE's rule: stem tokens longer than 3 characters (extended rules), keep the others."""
    return [porter_stem(t, True) if len(t) > 3 else t for t in tokens]


# ------------------------------------------------------------------ the extended rules as SQL expressions

def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _cut(n: int, of: str = "w") -> str:
    return f"left({of}, length({of}) - {n})"


def _vc(kinds: str) -> str:
    """Twice the measure."""
    return f"(length({kinds}) - length(replace({kinds}, 'vc', '')))"


def _kinds(letters: str) -> str:
    return "".join("v" if x in _VOWELS else "c" for x in letters)  # suffix tables hold no y


def _when(cases: list[tuple[str, int, str]]) -> tuple[str, str]:
    """(w, p) after the first case that holds: condition, letters cut, letters added."""
    return tuple("CASE " + " ".join(f"WHEN {c} THEN {_cut(n, of)} || '{kind(add)}'" for c, n, add in cases) + f" ELSE {of} END"
                 for of, kind in (("w", str), ("p", _kinds)))


def _first_suffix(rules: list[tuple[str, str]], measure: int, also: dict[str, str] | None = None) -> tuple[str, str]:
    """The longest suffix decides; the rule applies if the stem's measure is above ``measure`` and ``also`` holds."""
    cases = []
    for suffix, new in _longest_first(rules):
        n = len(suffix)
        cases += [(f"{_ends(suffix)} AND {_vc(_cut(n, 'p'))} > {2 * measure}" + (f" AND {also[suffix]}" if also and suffix in also else ""), n, new),
                  (_ends(suffix), 0, "")]
    return _when(cases)


def letter_kinds(word: str) -> str:
    """SQL for the kinds of a lower-case word's letters and digits.  A y is a consonant at the start and after a vowel; runs of up to ten
    y are followed, letter by letter."""
    kinds = f"translate({word}, 'aeioubcdfghjklmnpqrstvwxz0123456789', 'vvvvv{'c' * 30}')"
    kinds = f"regexp_replace({kinds}, '^y', 'c')"
    for _ in range(5):
        kinds = f"replace(replace({kinds}, 'vy', 'vc'), 'cy', 'cv')"
    return kinds


def stem_steps() -> list[tuple[str, str]]:
    """The steps of the extended algorithm, each as new values of w (word) and p (kinds), in the SQL that Spark and others share."""
    def cvc(n):
        w, p = _cut(n), _cut(n, "p")
        return f"((right({p}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {p} = 'vc')"

    double = f"length(w) > 2 AND right({_cut(1)}, 1) = left(right(w, 3), 1)"
    again = [  # after -ed or -ing is gone, marked by a plus sign
        (f"right({_cut(1)}, 2) IN ('at', 'bl', 'iz')", 1, "e"),
        (f"{double} AND right({_cut(1)}, 1) IN ('l', 's', 'z')", 1, ""),
        (f"{double} AND right({_cut(1, 'p')}, 1) = 'c'", 2, ""),
        (f"{_vc(_cut(1, 'p'))} = 2 AND {cvc(1)}", 1, "e"),
        ("true", 1, "")]
    marked = [(f"right(w, 1) = '+' AND ({c})", n, add) for c, n, add in again]
    removed = [(f"{_ends(s)} AND instr({_cut(len(s), 'p')}, 'v') > 0", len(s), "+") for s in ("ed", "ing")]
    step_1b = _when([("length(w) = 4 AND " + _ends("ied"), 1, ""), (_ends("ied"), 2, ""),
                     (f"{_ends('eed')} AND {_vc(_cut(3, 'p'))} > 0", 1, ""), (_ends("eed"), 0, ""), *removed])
    step_1b = (step_1b[0], step_1b[1].replace(f"|| '{_kinds('+')}'", "|| '+'"))
    # a letter's kind never depends on what follows it, so a cut word keeps its kinds
    return [
        _when([(_ends("sses"), 2, ""), ("length(w) = 4 AND " + _ends("ies"), 1, ""), (_ends("ies"), 2, ""), (_ends("ss"), 0, ""), (_ends("s"), 1, "")]),
        step_1b,
        _when(marked),
        _when([(f"{_ends('y')} AND length(w) > 2 AND right({_cut(1, 'p')}, 1) = 'c'", 1, "i")]),
        _when([(f"{_ends('alli')} AND {_vc(_cut(4, 'p'))} > 0", 2, "")]),
        tuple(f"CASE WHEN {_ends('logi')} THEN CASE WHEN {_vc(_cut(3, 'p'))} > 0 THEN {_cut(1, of)} ELSE {of} END ELSE {rest} END"
              for of, rest in zip("wp", _first_suffix(STEP2_EXTENDED, 0))),
        _first_suffix(STEP3, 0),
        _first_suffix([(s, "") for s in STEP4], 1, {"ion": f"right({_cut(3)}, 1) IN ('s', 't')"}),
        _when([(f"{_ends('e')} AND ({_vc(_cut(1, 'p'))} > 2 OR ({_vc(_cut(1, 'p'))} = 2 AND NOT {cvc(1)}))", 1, "")]),
        _when([(f"{_ends('ll')} AND {_vc('p')} > 2", 1, "")]),
    ]


def last_choice(word: str = "word") -> str:
    """SQL of the stem of ``word`` from the last step's w: irregular and short words go their own way."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return f"CASE {word} {irregular} ELSE CASE WHEN length({word}) <= 2 THEN {word} ELSE w END END"


def stem_words(words: DataFrame) -> DataFrame:
    """word, stem of each row of ``words`` (a column ``word``: lower-case letters and digits), by SQL expressions alone."""
    # a generator of one row ends each step: the steps stay apart instead of growing into one expression
    now = words.selectExpr("word", f"inline(array(struct(word AS w, {letter_kinds('word')} AS p)))")
    for w, p in stem_steps():
        now = now.selectExpr("word", f"inline(array(struct({w} AS w, {p} AS p)))")
    return now.selectExpr("word", f"{last_choice()} AS stem")

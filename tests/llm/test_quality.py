import math
import re
from collections import Counter

import pytest

from evalgrid.llm import quality as Q
from evalgrid.llm.common import read_table

SPACE = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), dup, len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def rows_of(df):
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()


def test_base_counts(make_docs, odd_rows, spark):
    rows = odd_rows + [(1, "a b c d e f g h " * 3), (2, "é#$ x y\x0bz\n\nline one\nline one\n"), (3, "w " * 9), (4, "a b c d e f g h i a b c d e f g h"),
                       (5, "😀 <b> & %")]
    got = sorted((repr(r[0]), *r[1:]) for r in rows_of(Q.base_counts(make_docs(rows).drop("n_words"))))
    assert got == sorted((repr(i), *base(t)) for i, t in rows)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r)[1:] == base(texts[r.doc_id]) for r in rows_of(Q.base_counts(docs)))


def test_verdict(spark, make_docs, odd_rows):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = Q.quality(docs).join(read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    good = [r for r in out if r.quality and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert not any(r.kept for r in out if r.base_failed)
    bad = [r for r in out if not r.quality]
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad)
    odd = Q.quality(make_docs(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and not any(r.kept for r in odd)
    assert all(r.score == "a" and isinstance(r.n_words, int) for r in odd)
    assert Q.quality(make_docs([])).count() == 0


def shares_of(counts):
    return [c / max(sum(counts), 1e-9) for c in counts]


def classes_of(text):
    found = Counter()
    for c in text:
        if c in SPACE:
            found["space"] += 1
        elif c.isalpha():
            found["capital" if c.isupper() else "letter"] += 1
        elif c.isnumeric():
            found["digit"] += 1
        else:
            found["stop" if c in ".,;:!?'\"()-" else "mark"] += 1
    return shares_of([found[k] for k in ("letter", "capital", "digit", "stop", "mark", "space")])


def distance(p, q):
    def half(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0) / 2
    return math.sqrt(max(half(p, q) + half(q, p), 0))


def verdicts(rows, top=Q.TOP_WORDS):
    """The distances and the verdict of each (id, text, lang), with references by brute force."""
    groups = {}
    for i, text, lang in rows:
        key = re.match(r"\s*([^\W\d_]*)", lang or "").group(1).lower()
        groups.setdefault(key, []).append((i, text or ""))
    out = []
    for docs in groups.values():
        words = [[w for w in re.split(f"[{SPACE}]+", t.lower()) if w] for _, t in docs]
        seen = Counter(w for found in words for w in set(found) if len(w) <= Q.MAX_WORD)
        common = sorted(seen, key=lambda w: (-seen[w], w))[:top]
        counts = [Counter(found) for found in words]
        shares = [shares_of([c[w] for w in common] + [len(found) - sum(c[w] for w in common)]) for c, found in zip(counts, words)]
        classes = [classes_of(t) for _, t in docs]
        good = [k for k, (_, t) in enumerate(docs) if not base(t)[5]]

        def mean(rows):
            return [sum(rows[k][j] for k in good) / len(good) for j in range(len(rows[0]))] if good else None
        for k, (i, t) in enumerate(docs):
            char, word = (distance(own[k], mean(own)) if good else 0.0 for own in (classes, shares))
            slack = 1 / math.sqrt(max(len(words[k]), 1))
            out.append((i, char, word, not base(t)[5] and char <= Q.MAX_CHAR_DISTANCE + slack / 2 and word <= Q.MAX_WORD_DISTANCE + slack))
    return out


def check_verdicts(docs, rows):
    got = {r.doc_id: (r.char_distance, r.word_distance, r.kept) for r in Q.quality(docs).collect()}
    expected = verdicts(rows)
    assert len(got) == len(expected)
    for i, char, word, kept in expected:
        assert got[i][:2] == pytest.approx((char, word), abs=1e-6), i
        assert got[i][2] == kept
    return got


def test_references_and_verdict_by_brute_force(spark, make_docs, monkeypatch):
    table = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()]
    check_verdicts(table, rows)
    # more languages than may be broadcast or be literals: the same by an ordinary join
    monkeypatch.setattr(Q, "MAX_BROADCAST_LANGS", 0)
    monkeypatch.setattr(Q, "MAX_LITERAL_LANGS", 0)
    check_verdicts(table, rows)


def test_every_language_is_learned(make_docs):
    """Languages without any given list, spelled in several ways, or null."""
    plain = "una casa e il mare di una sera che non si vede e poi il sole torna di nuovo sul mare e la sera viene {} volte"
    odd = "zq9 " * 3 + " ".join(f"xk{i}%" for i in range(30))
    rows = [(i, plain.format(i), lang) for i, lang in enumerate(["it", "IT", "it-CH", " it"] * 10 + [None, "", "??"] * 10)]
    rows += [(100, odd, "it"), (101, odd, None), (102, odd, "fi")]
    got = check_verdicts(make_docs(rows), rows)
    assert all(got[i][2] for i in range(70)) and all(got[i][1] > 0 for i in range(70))
    assert not got[100][2] and not got[101][2]
    assert got[102][2]  # the only document of its language


def test_distance(spark):
    row = spark.sql("select array(0.5D, 0.5D, 0D) p, array(0.5D, 0.5D, 0D) q, array(0D, 0D, 1D) r").select(
        Q.js_distance("p", "q").alias("same"), Q.js_distance("p", "r").alias("apart")).first()
    assert row.same == 0 and abs(row.apart - 1) < 1e-9

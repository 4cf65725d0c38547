import math
import random
import zlib
from collections import Counter

import numpy as np

from evalgrid.llm import language as L


def kt(a, b):
    p, z, o = 1.0, 0, 0
    for bit in [0] * a + [1] * b:
        p *= ((o if bit else z) + 0.5) / (z + o + 1)
        z, o = z + (not bit), o + bit
    return p


def brute_probability(words, depth, query):
    """log10 of the probability of a word under context-tree weighting, straight from the definition."""
    counts = {}  # (bits so far, context) -> [zeros, ones]

    def steps(word):
        data = b" " + word + (b"" if word == L.END else b" ")
        for i in range(1, len(data)):
            context = (b"\0" * depth + data[:i])[-depth:]
            for k in range(8):
                yield data[i] >> (8 - k) | 1 << k, context, data[i] >> (7 - k) & 1
    for word, n in words.items():
        for path, context, bit in steps(word):
            for d in range(depth + 1):
                counts.setdefault((path, context[depth - d:]), [0, 0])[bit] += n

    def weight(path, s):
        own = kt(*counts[path, s])
        if len(s) == depth:
            return own
        rest = 1.0
        for (p, t) in list(counts):
            if p == path and len(t) == len(s) + 1 and t[1:] == s:
                rest *= weight(p, t)
        return 0.5 * own + 0.5 * rest
    total = 0.0
    for path, context, bit in steps(query):
        p = None
        for d in range(depth, -1, -1):
            s = context[depth - d:]
            if (path, s) not in counts:
                continue
            z, o = counts[path, s]
            one = (o + 0.5) / (z + o + 1)
            share = 0.5 * kt(z, o) / weight(path, s) if d < depth else 1.0
            p = one if p is None else share * one + (1 - share) * p
        p = 0.5 if p is None else p
        total += math.log10(p if bit else 1 - p)
    return total


def scores(spark, words, depth):
    table = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()], "token binary, train long").cache()
    grams = L.count_grams(table, depth).cache()
    model = L.gram_scores(grams, depth).cache()
    return table, model


def test_equals_definition_and_both_paths(spark):
    words = {b"abba": 3, b"ab": 2, b"cab": 1, L.END: 4, b"bad": 0, "é".encode(): 1}
    table, model = scores(spark, words, 3)
    wide = {bytes(r.token): r.lp for r in L.word_scores(table, model, 3).collect()}
    narrow = {bytes(r.token): r.lp for r in L.word_scores(table, model, 3, max_broadcast=0).collect()}
    for w in words:
        want = brute_probability({k: n for k, n in words.items() if n}, 3, w)
        assert abs(wide[w] - want) < 1e-9 and abs(narrow[w] - want) < 1e-9


def test_decisions_are_a_distribution():
    keys, _ = L.grams_of([b"abc", b"abd", b"xyz"], 3)
    levels = L.tree(np.unique(keys), np.ones(len(np.unique(keys)), int), 3, 0)
    assert all(((0 < lv.kt) & (lv.kt < 1)).all() and ((0 <= lv.own) & (lv.own <= 1)).all() for lv in levels)


def test_documents(spark, make_docs, odd_rows):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(vocabulary).title() for _ in range(rnd.randint(0, 30)))) for i in range(60)] + odd_rows
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    counts = Counter(w for i, t in rows if train(i) for w in L.tokens_of(t))
    n, v = counts.total(), len(counts)
    for frequent in (1 << 18, 3):
        out = L.score_documents(make_docs(rows), frequent=frequent).collect()
        got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
        want = sorted((repr(i), not train(i), len(ts), sum(counts[w] > 0 for w in ts), n,
                       round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), 6)) for i, t in rows for ts in [L.tokens_of(t)])
        assert got == want
        assert all(r.score < 0 for r in out)
    assert L.score_documents(make_docs([])).count() == 0

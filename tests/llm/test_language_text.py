"""op4 over running text: contexts go on across spaces."""

import math
import zlib

import pytest

from evalgrid.llm import language as L


def kt(zeros, ones):
    return math.exp(math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1)) / math.pi


def brute_score(training, text, depth):
    """log10 of the probability of a text under context-tree weighting, straight from the definition."""
    def steps(t):
        data = b" " + b"".join(w + b" " for w in t.encode().split()) + b"\n"
        for i in range(1, len(data)):
            context = (b"\0" * depth + data[:i])[-depth:]
            for k in range(8):
                yield data[i] >> (8 - k) | 1 << k, context, data[i] >> (7 - k) & 1
    counts = {}
    for t in training:
        for path, context, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((path, context[depth - d:]), [0, 0])[bit] += 1
    children = {}
    for path, s in counts:
        if s:
            children.setdefault((path, s[1:]), []).append((path, s))
    memo = {}

    def weight(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[1]) == depth else 0.5 * own + 0.5 * math.prod(weight(c) for c in children[node])
        return memo[node]
    total = 0.0
    for path, context, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            node = (path, context[depth - d:])
            if node in counts:
                z, o = counts[node]
                one = (o + 0.5) / (z + o + 1)
                share = 0.5 * kt(z, o) / weight(node) if d < depth else 1.0
                p = one if p is None else share * one + (1 - share) * p
        p = 0.5 if p is None else p
        total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("max_broadcast", [L.MAX_BROADCAST_GRAMS, 0])
def test_score_is_that_of_the_running_text(spark, make_docs, max_broadcast, monkeypatch):
    monkeypatch.setattr(L, "_RUN", 40)  # texts of one batch take several runs
    words = ["ab", "ba", "c", "É", "abc"]
    texts = [" ".join(words[(i * j + i) % 5] for j in range(i % 7)) for i in range(30)] + ["ab\tba\n c ", None]
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in L.score_documents(make_docs(list(enumerate(texts))), depth=4, max_broadcast=max_broadcast).collect()}
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_score([lower(x) for x in train], lower(t), 4)) < 1e-9


def test_order_of_words_counts(spark, make_docs):
    rows = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(20)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(held[0], "the cat sat on the mat"), (held[1], "mat the on sat cat the")]
    got = {r.doc_id: r for r in L.score_documents(make_docs(rows)).collect()}
    assert got[held[0]].base_score == got[held[1]].base_score
    assert got[held[0]].score > got[held[1]].score + 1

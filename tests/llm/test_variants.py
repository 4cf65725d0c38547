import random
import re
import zlib
from collections import Counter

from evalgrid.llm import queries
from evalgrid.llm import variants as V
from evalgrid.llm.common import read_table


def count_words(docs, min_length=5, min_count=3, every=97):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{word}".encode())
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}


def one_apart(word, alphabet):
    cut = [word[:i] + word[i + 1:] for i in range(len(word))]
    changed = [word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet]
    longer = [word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet]
    return {*cut, *changed, *longer} - {word}


def brute(words):
    alphabet = sorted({c for w in words for c in w})
    near = {w: one_apart(w, alphabet) & words.keys() for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def as_dict(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "WORDS_PER_TASK", 60)  # several ranges that share nodes
    rng = random.Random(5)
    words = {"".join(rng.choice("abà") for _ in range(rng.randint(1, 7))): rng.choice([3, 4, 6, 9, 20, 50]) for _ in range(600)}
    words |= {"aaaaaaa": 90, "aaaaaaaa": 700, "x" * 3000: 5, "x" * 3001: 12, "x" * 2999 + "y": 2, "éçèàù": 3, "éçèàÿ": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_dict(V.variants(table))
    assert got == brute(words)
    assert sum(1 for x in got.values() if x[0] and x[0] != x[1]) > 20  # chains of forms


def test_nodes_are_prefixes(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    rows = V.number_trie(spark.createDataFrame([(w,) for w in words], "key string"), 9).collect()
    number = {}
    for r in rows:
        assert len(r.nodes) == len(r.key) + 1
        for i, node in enumerate(r.nodes):
            assert number.setdefault(r.key[:i], node) == node
    assert len(set(number.values())) == len(number)
    assert [r.key for r in sorted(rows, key=lambda r: r.place)] == words


def test_whole_texts(make_docs, odd_rows):
    docs = odd_rows + [(i, f"Straße straße ÀÉÎÕÜ colour colour color wordcount{i} word×part öööööö " * 5) for i in range(300)]
    words = count_words(docs)
    assert any(w.startswith("colo") and w not in ("colour", "color") or w == "straß" for w in words)  # letters were deleted
    assert as_dict(V.variants(V.vocabulary(make_docs(docs)))) == brute(words)
    assert V.variants(V.vocabulary(make_docs([]))).count() == 0
    assert V.variants(V.vocabulary(make_docs([(1, None), (2, "")]))).count() == 0


def test_query_equals_brute_force(spark, small_sf):
    docs = [(r.doc_id, r.text) for r in read_table(spark, small_sf, "documents").collect()]
    assert as_dict(queries.op13_variants(spark, small_sf)) == brute(count_words(docs))

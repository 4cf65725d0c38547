import hashlib
import random

import numpy as np
import pytest

from evalgrid.llm import suffix_dedup as S


def corpus(seed, n=30):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdé ") for _ in range(k))
    passages = [word(rnd.randint(100, 420)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = "".join(rnd.choice(passages) if rnd.random() < 0.5 else word(rnd.randint(5, 150)) for _ in range(rnd.randint(0, 5)))
        if rnd.random() < 0.15:
            t += "xy" * 180
        texts.append(rnd.choice(texts) if texts and rnd.random() < 0.2 else t)
    return texts


def expected(texts):
    raw = [(t or "").encode() for t in texts]
    out = []
    for b, spans in zip(raw, S.brute_force(raw, S.MIN_MATCH)):
        edges = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in df.collect())


@pytest.mark.parametrize("hot,queue_rows", [(512, 1_000_000), (2, 5)])
def test_equals_brute_force(make_docs, odd_rows, hot, queue_rows):
    rows = list(enumerate(corpus(5))) + odd_rows
    want = sorted((i is not None, i or 0, *w) for (i, _), w in zip(rows, expected([t for _, t in rows])))
    assert result(S.remove_repeats(make_docs(rows), hot=hot, queue_rows=queue_rows)) == want


def test_shared_line_in_many_documents(make_docs):
    rnd = random.Random(3)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(120)) + line + str(i) * 40) for i in range(60)]
    want = sorted((True, i, *w) for (i, _), w in zip(rows, expected([t for _, t in rows])))
    assert result(S.remove_repeats(make_docs(rows), hot=8)) == want


def test_texts_without_ids(make_docs):
    """Many different texts of one null id, each known by itself."""
    rnd = random.Random(11)
    part = ["".join(rnd.choice("abcdefgh ") for _ in range(230)) for _ in range(40)]
    rows = [(None, f"{i} " + "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(60))) + (part[i % 40] if i % 3 else part[i % 40][:150]) + f" {i}")
            for i in range(1500)]
    want = sorted((False, 0, *w) for w in expected([t for _, t in rows]))
    assert result(S.remove_repeats(make_docs(rows))) == want


def test_empty_table(make_docs):
    assert S.remove_repeats(make_docs([])).count() == 0


def test_equal_windows_name_equal_places():
    rnd = np.random.default_rng(1)
    part = rnd.integers(97, 105, 400).astype(np.uint8)
    a = np.concatenate([rnd.integers(97, 105, 50).astype(np.uint8), part])
    ha, pa, fa, la = S.anchors(a)
    hb, pb, fb, lb = S.anchors(part)
    at = {int(w): int(p) - 50 for p, x, y in zip(pa, fa, la) for w in range(x - 50, y - 49)}
    assert all(at[w] == p for p, x, y in zip(pb.tolist(), fb, lb) for w in range(x, y + 1))


def test_queue_spills_and_keeps_order():
    q = S.SpillQueue(limit=7)
    rnd = np.random.default_rng(2)
    keys = rnd.integers(0, 9, 60)
    for part in np.array_split(np.arange(60), 12):
        q.push(keys[part], part)
    assert q.runs
    got, places = q.pop_all()
    assert list(got) == sorted(keys) and list(places) == list(np.argsort(keys, kind="stable")) and not q.runs

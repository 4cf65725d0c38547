import random

from evalgrid.llm import lines as L


def distance_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def brute_force(rows, keyed):
    """Kept text of each distinct (doc_id, text), by comparing all lines."""
    order = sorted(keyed, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    seen, out = [], {}
    for doc, fp in order:
        text = keyed[doc, fp]
        if text is None:
            out[doc, text] = None
            continue
        kept, mine = [], []
        for line in text.split("\n"):
            if len(line) < L.MIN_CHARS or not any(distance_at_most_one(line, x) for x in seen + mine):
                kept.append(line)
            if len(line) >= L.MIN_CHARS:
                mine.append(line)
        seen += mine
        out[doc, text] = "\n".join(kept)
    return out


def test_equals_brute_force(spark, make_docs, odd_rows):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdé ñ") for _ in range(rnd.randint(18, 60))) for _ in range(25)]

    def edited(s):
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(s) + 1)
            s = rnd.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1:], s[:i] + "y" + s[i + 1:]])
        return s
    rows = [(i % 37, "\n".join(rnd.choice(["", "short", edited(rnd.choice(base))]) for _ in range(rnd.randint(1, 7)))) for i in range(60)] + odd_rows
    docs = make_docs(rows)
    keyed = {(r.doc_id, r._fp): r.text for r in L._keyed(docs).select("doc_id", "_fp", "text").collect()}
    want = brute_force(rows, keyed)
    got = L.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    source = {(i, t) for i, t in rows}
    texts = sorted((repr(r.doc_id), repr(r.text)) for r in got)
    assert texts == sorted((repr(i), repr(want[i, t])) for i, t in rows) and source
    assert all(r.n_removed >= 0 and r.score == "a" for r in got)


def test_empty_table(make_docs):
    assert L.dedup_lines(make_docs([])).count() == 0


def test_short_lines_are_removed_when_equal(spark, make_docs, tmp_path):
    """The query and the pipeline keep the earliest of equal short lines; a short line one edit away stays."""
    from corpus_pipeline import dedup_lines
    from evalgrid.llm.queries import op2_lines
    rows = [(i, f"line number {i} of its own and long enough {i * 7919}\n\nRead more\nx\nRead mor{i}") for i in range(1, 6)]
    want = [rows[0][1]] + [f"line number {i} of its own and long enough {i * 7919}\n\nRead mor{i}" for i in range(2, 6)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    assert [r.text for r in dedup_lines(spark, docs, "").orderBy("doc_id").collect()] == want
    assert [r.text for r in L.dedup_lines(make_docs(rows)).orderBy("doc_id").collect()] == [t for _, t in rows]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.n_lines, r.n_removed, r.n_chars) for r in op2_lines(spark, str(tmp_path)).orderBy("doc_id").collect()] == [
        (5, 0 if i == 0 else 2, len(t)) for i, t in enumerate(want)]

"""op10: pages that mark their article go through the host's suffix array too."""

from evalgrid.llm import extract_html as H

LETTER = "Subscribe to our weekly letter and never miss a single story from our desk"


def texts(spark, pages):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_boilerplate_inside_marked_articles(spark):
    own = {i: " ".join(f"word{i}x{j}" for j in range(40)) for i in range(30)}
    shared = " ".join(f"copied{j}" for j in range(12))
    rows = [(i, f"http://a.com/{i}", f"<article><p>{own[i]}</p><p>{LETTER}</p><p>tail{i}</p></article>") for i in range(5)]
    rows += [(10 + i, f"http://b.com/{i}", f"<article><p>{own[10 + i]}</p>{f'<p>{shared}</p>' if i < 2 else ''}</article>") for i in range(5)]  # two pages of five: their own
    rows += [(20 + i, f"http://c.com/{i}", f"<main><p>{shared} {own[3]}</p><p>end{i}</p></main>") for i in range(4)]  # near copies: whole
    rows += [(30 + i, f"http://d.com/{i}", f"<article><p>{LETTER}</p><p>{own[20 + i]}</p></article>") for i in range(2)]  # too few pages
    rows += [(0, "http://a.com/0", rows[0][2])]
    got = texts(spark, rows)
    assert all(got[i] == f"{own[i]} tail{i}" for i in range(5))
    assert all(got[10 + i] == own[10 + i] + (f" {shared}" if i < 2 else "") for i in range(5))
    assert all(got[20 + i] == f"{shared} {own[3]} end{i}" for i in range(4))
    assert all(got[30 + i] == f"{LETTER} {own[20 + i]}" for i in range(2))


def test_blocks_outside_a_mark_are_witnesses(spark):
    rows = [(1, "http://a.com/1", f"<div>{LETTER}</div><article>first text</article>"), (2, "http://a.com/2", f"<p>{LETTER}</p><p>second text</p>"),
            (3, "http://b.com/3", f"<p>{LETTER}</p><p>third text</p>")]
    assert texts(spark, rows) == {1: "first text", 2: "second text", 3: f"{LETTER} third text"}


def test_anchors_are_common_to_equal_runs():
    run = "one two three four five six seven eight nine ten".split()
    a, b = H.anchors(["x", "y"] + run + ["z"]), H.anchors(run + ["q"] * 5)
    assert a[2] == b[0] and len(a) == 4 and len(H.anchors(run[:9])) == 0

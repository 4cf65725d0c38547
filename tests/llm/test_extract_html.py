import html
import re
import time

from evalgrid.llm import extract_html as H
from evalgrid.llm.common import read_table


def text_of(page):
    found = H.blocks(page)
    best = max([0, *(k for k, _ in found)])
    return " ".join(t for k, t in found if k == best)


def test_structure():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</ul></nav>
    <div class="cookie-banner">accept</div><article class=post><header><h1>A &amp;&nbsp; title</h1></header><p>One <b>bo</b>ld<br>two
    <p>three <script>var a = "</p>";</script>four<aside>side</aside><form>f <input></form><div class="ad">buy</div><!-- no > -->
    <section id="comments"><p>reader</p></section></article><footer>foot</footer></body></html>"""
    assert text_of(page) == "A & title One bold two three four"
    assert text_of("<main><p>x</p><article>y</article></main>") == "x y"
    assert text_of("") == "" and text_of("<nav>x") == "" and text_of("plain &lt;b&gt; text") == "plain <b> text"
    assert text_of("<article><p>a<b>b<p>c</article></b></p>d") == "ab c"
    assert text_of("<p>cut <a href='x") == "cut"


def test_text_inside_marks_stays():
    assert text_of("<main><p>Real text.</p><article>Card</article><p>More.</p></main><div>chrome</div>") == "Real text. Card More."
    assert text_of("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></article>") == "Let x=1 be so."
    assert text_of("<article><p class='related-work'>kept</p><p class='post ad'>buy</p><div class='related-posts'>others</div><p>end</p></article>") == "kept end"
    assert text_of("<article>a<span class='share-count'>b</span> c</article>") == "ab c"


def test_deep_unclosed_markup():
    """Time in proportion to the page: elements that never end, and end tags that end nothing."""
    n = 40_000
    begun = time.process_time()
    assert text_of("<article><i>" + "<div>" * n + "x" + "</i>" * n + "</u>" * n + "<b>" * n + "</i>" * n + "y</article>z") == "xy"
    assert time.process_time() - begun < 10


def test_given_pages(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    for r, p in zip(H.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert (r.page_id, r.text, r.n_chars) == (p.page_id, want, len(want))


def test_host_array_removes_repeated_runs(spark):
    common = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, "http://a.com/%d" % i, f"<div>{common}</div><p>own{i} text{i} of page{i}</p>") for i in range(4)]
    rows += [(10, "http://b.com/", f"<div>{common}</div><p>alone here</p>"), (11, None, None), (12, "http://a.com/x", ""), (None, "x", "<p>q</p>"),
             (13, "http://c.com/1", f"<p>{common} copy</p>"), (14, "http://c.com/2", f"<p>{common} copy</p>"), (0, "http://a.com/0", rows[0][2])]
    got = sorted((repr(r.page_id), r.text, r.n_chars) for r in H.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect())
    own = lambda i: f"own{i} text{i} of page{i}"
    want = [(i, own(i)) for i in range(4)] + [(0, own(0)), (10, common + " alone here"), (11, ""), (12, ""), (None, "q"), (13, common + " copy"), (14, common + " copy")]
    assert got == sorted((repr(i), t, len(t)) for i, t in want)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""Operator 10: main text of web pages, with a suffix array per host for boilerplate that markup doesn't show.

A page is read into blocks (block elements and line breaks end one).  Blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and the like are page chrome, by element, role, or a
word of their class or id (of the article's own paragraphs, headings and the like only as a whole class or id: ``ad``,
but not ``related-work``).  If the page marks its article (``article``, ``main`` or ``itemprop=articleBody``), its own stream
is the blocks in the marks that are not chrome, those of ``main`` around an ``article`` too; else all that are not chrome.

Every page goes through its host's suffix array.  The token streams of the host's pages are concatenated
(blocks in page order; the other blocks of each page take part as witnesses), their suffixes are sorted, and neighbours in
that order that agree in ``MIN_RUN`` or more tokens and come from distinct pages (pages of the same stream
are one) are repeated runs.  Tokens that a repeated run covers are removed, and the rest is the text.  Markup is
evidence for what a run is: without a mark one other page or witness is enough.  Inside a mark, a copy may as well be
an article that two pages share, so a run counts if the own streams of more than half of the host's pages, and of
``MIN_PAGES`` at least, hold it; and a page that would so lose more than half of its tokens is a copy, and stays whole.

Only the array's order down to ``MIN_RUN`` tokens decides, so it is dealt out by host and those tokens.  A head that repeats
has its smallest ``ANCHOR``-token hash in common with the others, so anchors that repeat in the host are found
first, and only the suffixes at those are dealt out, whose heads are then compared token for token.

Defined cases: null or empty html, and pages that are all chrome, have an empty text and 0 characters; null ids
and urls stay (a null url is one host of its own); broken markup (elements that never end, end twice or overlap)
ends at the nearest open element of its kind; repeated rows are extracted each and count as one page; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from evalgrid.llm.common import cut

MIN_RUN = 10
MIN_PAGES = 3
ANCHOR = 3
_FILTER = 1 << 20  # flags by which pages without a repeated anchor, and hosts without unmarked pages, pass the joins by

# HTML's element kinds, and the class words that mark page chrome.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup "
                   "time tt u var wbr rp rt img math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover "
                   "munderover mstyle mfenced".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation object canvas audio video xmp".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
CHROME = frozenset("nav footer aside form button select dialog menu head noscript fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr "
    "login masthead menu modal nav navbar navigation navigator newsletter notice notices notification outbrain pagination paywall popup "
    "promo promotion related recommended respond reply replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription taboola toolbar widget widgets".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _is_chrome(name: str, attrs: str, in_article: bool) -> bool:
    if name in CHROME or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body"):
        return False
    found = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTR.findall(attrs)}
    if found.get("role") in CHROME_ROLES or found.get("aria-hidden") == "true" or "hidden" in found:
        return True
    if "display:none" in found.get("style", "").replace(" ", ""):
        return True
    names = [found.get(k, "") for k in ("class", "id")]
    if in_article and (name in TEXT or name in INLINE):
        return any(w in CHROME_WORDS for x in names for w in x.split())
    return any(w in CHROME_WORDS for x in names for w in _WORD.findall(x))


def _is_article(name: str, attrs: str) -> bool:
    return name in ("article", "main") or "articleBody" in attrs or bool(re.search(r"role\s*=\s*[\"']?main\b", attrs))


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, white space made single; kind: -1 chrome, 0 plain, 1 article."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind of their content
    places: dict[str, list[int]] = {}  # where in the stack each name is open, and below where block elements are
    block_places: list[int] = []
    kind, at, n = 0, 0, len(html)

    def close(size):
        while len(stack) > size:
            name = stack.pop()[0]
            places[name].pop()
            if name not in INLINE:
                block_places.pop()

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((kind, text))

    def say(text):
        if text:
            parts.append(unescape(text) if "&" in text else text)

    while at < n:
        tag = _TAG.search(html, at)
        if not tag:
            say(html[at:])
            break
        say(html[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name not in INLINE:
                flush()
            if places.get(name):
                # an inline end tag never ends a block element, nor a paragraph the part that holds it
                if name in INLINE and block_places and block_places[-1] > places[name][-1]:
                    continue
                close(places[name][-1])
                after = stack[-1][1] if stack else 0
                if after != kind:
                    flush()
                    kind = after
            continue
        attrs = tag[3] or ""
        if name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
            kind = stack[-1][1] if stack else 0
        inner = kind
        if kind >= 0:
            inner = -1 if _is_chrome(name, attrs, kind > 0) else max(kind, int(_is_article(name, attrs)))
        if inner != kind:
            flush()
            kind = inner
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            block_places.append(len(stack))
        stack.append((name, kind))
    flush()
    return out


def _key(*parts: str) -> int:
    """A long that is equal for equal texts."""
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def own_stream(html: str | None) -> tuple[bool, str, str]:
    """(the page marks its article, own, other): the tokens of the own stream and of all other blocks, joined by spaces."""
    found = blocks(html or "")
    mark = max([0, *(k for k, _ in found)])
    return mark > 0, " ".join(t for k, t in found if k == mark), " ".join(t for k, t in found if k != mark)


def read_pages(pages: DataFrame, emit, schema: str) -> DataFrame:
    """The rows that ``emit(page_id, url, host, marked, own, other)`` gives of each page.  Pages are read from their html by every
    pass: a stored copy would be as large as the table."""
    def run(batches):
        for batch in batches:
            rows = [r for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
                    for r in emit(page_id, url, host_of(url), *own_stream(html.as_py()))]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def anchors(tokens: list[str], min_run: int = MIN_RUN) -> np.ndarray:
    """For each start of ``min_run`` tokens, the smallest hash of ``ANCHOR`` tokens among them: equal for equal tokens."""
    size = min(ANCHOR, min_run)
    if len(tokens) < min_run:
        return np.zeros(0, np.int64)
    one = np.array([crc32(t.encode("utf-8", "surrogatepass")) for t in tokens], dtype=np.uint64)
    gram = np.zeros(len(tokens) - size + 1, dtype=np.uint64)
    for i in range(size):
        gram = (gram ^ one[i:len(one) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(gram, min_run - size + 1).min(axis=1).view(np.int64)


def _flags(keys: DataFrame) -> np.ndarray:
    """``_FILTER`` flags, set at the places of the longs of ``keys``' one column."""
    at = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(_FILTER)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    flags = np.zeros(_FILTER, dtype=bool)
    flags[at] = True
    return flags


def page_key(host: str, marked: bool, own: str) -> int:
    return _key(host, str(marked), own)


def streams_of(open_hosts):
    """(host, page, role, text) of a page: role 1 own stream of a page that marks its article, 0 of one that doesn't, -1 its other
    blocks (of the flagged hosts, which have pages without a mark: elsewhere a witness decides nothing)."""
    def emit(page_id, url, host, marked, own, other):
        yield host, page_key(host, marked, own), int(marked), own
        if other and open_hosts.value[_key(host) % _FILTER]:
            yield host, _key(host, other, own, str(marked)), -1, other
    return emit


def repeated_anchors(pages: DataFrame, streams, min_run: int = MIN_RUN) -> DataFrame:
    """page, host_pages, anchors: the anchors of each stream that may belong to a run to remove."""
    def emit(*page):
        for host, key, role, text in streams(*page):
            got = np.unique(anchors(text.split(" "), min_run)) ^ np.int64(_key(host))
            yield key, role, got.tolist(), _key(host) if role >= 0 else None  # the last to count the host's pages

    read = read_pages(pages, emit, "page long, role int, found array<long>, host long")
    all_keys = F.concat(F.transform("found", lambda x: F.struct(x.alias("key"), F.lit(False).alias("count_row"))),
                        F.when(F.col("host").isNull(), F.array().cast("array<struct<key:bigint,count_row:boolean>>")).otherwise(
                            F.array(F.struct(F.col("host").alias("key"), F.lit(True).alias("count_row")))))
    rows = read.select("page", "role", F.explode(all_keys).alias("k")).select("k.key", "page", "role", "k.count_row")
    distinct = rows.repartition("key").groupBy("key", "page", "role", "count_row").agg(F.lit(1))
    w = Window.partitionBy("key", "count_row")  # a page is at most one row of a key
    low = F.when(F.col("role") <= 0, F.col("page"))
    counted = distinct.select("*", F.sum((F.col("role") >= 0).cast("long")).over(w).alias("n"), (F.min(low).over(w) != F.max(low).over(w)).alias("twice"))
    kept = counted.where(F.col("count_row") | (F.col("role") <= 0) & F.col("twice") | (F.col("role") >= 0) & (F.col("n") >= MIN_PAGES))
    per = kept.groupBy("page", "role").agg(F.max(F.when(F.col("count_row"), F.col("n"))).alias("host_pages"), F.collect_list(F.when(
        ~F.col("count_row"), F.struct("key", "n", "twice"))).alias("a"))
    good = F.filter("a", lambda x: (F.col("role") <= 0) & x["twice"] | (F.col("role") >= 0) & (2 * x["n"] > F.col("host_pages")))
    return per.select("page", "host_pages", F.transform(good, lambda x: x["key"]).alias("anchors")).where(F.size("anchors") > 0)


def repeated_places(found: DataFrame, wanted: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(page, at): where a suffix starts whose first ``min_run`` tokens are those of a run to remove.

    ``found``: distinct streams; ``wanted``: their rows of ``repeated_anchors``."""
    def suffixes(batches):
        for batch in batches:
            out = {k: [] for k in ("host", "page", "role", "host_pages", "at", "head", "first")}
            for host, page, role, text, host_pages, keys in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.split(" ")
                seen = set()
                for i in np.flatnonzero(np.isin(anchors(tokens, min_run) ^ np.int64(_key(host)), np.array(keys, dtype=np.int64))).tolist():
                    head = " ".join(tokens[i:i + min_run])
                    for name, value in zip(out, (host, page, role, host_pages, i, head, head not in seen)):
                        out[name].append(value)
                    seen.add(head)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))],
                                             names=list(out))

    # the array's order down to min_run tokens decides which neighbours agree: equal heads are one run of it
    array = found.join(wanted, "page").select("host", "page", "role", "text", "host_pages", "anchors").mapInArrow(
        suffixes, "host string, page long, role int, host_pages long, at int, head string, first boolean")
    low = F.when(F.col("role") <= 0, F.col("page"))
    runs = array.groupBy("host", "head").agg(F.min(low).alias("a"), F.max(low).alias("b"), F.max("host_pages").alias("all"),
                                             F.sum(F.when(F.col("first") & (F.col("role") >= 0), 1).otherwise(0)).alias("n"))
    runs = runs.select("host", "head", (F.col("a") != F.col("b")).alias("twice"), ((F.col("n") >= MIN_PAGES) & (2 * F.col("n") > F.col("all"))).alias("most"))
    return array.join(runs.where("twice or most"), ["host", "head"]).where("role <= 0 and twice or role = 1 and most").select("page", "at")


def extract(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    share = pages.sparkSession.sparkContext.broadcast

    def open_host(page_id, url, host, marked, own, other):
        return [] if marked else [(_key(host),)]

    streams = streams_of(share(_flags(read_pages(pages, open_host, "host long"))))
    wanted = cut(repeated_anchors(pages, streams, min_run), "pages-anchors")
    suspects = share(_flags(wanted.select("page")))
    found = read_pages(pages, lambda *page: (s for s in streams(*page) if suspects.value[s[1] % _FILTER]), "host string, page long, role int, text string")
    places = repeated_places(found.dropDuplicates(["page"]), wanted, min_run)
    marks = cut(places.groupBy("page").agg(F.sort_array(F.collect_set("at")).alias("starts")), "pages-marks")
    flags = _flags(marks.select("page"))
    removing = share(flags)

    def unique(batches):
        for batch in batches:
            texts = []
            for own, marked, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                tokens = own.split(" ")
                edge = np.zeros(len(tokens) + min_run + 1, dtype=np.int32)
                if starts:
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + min_run, -1)
                covered = np.cumsum(edge)[:len(tokens)] > 0
                texts.append(own if marked and 2 * covered.sum() > len(tokens) else " ".join(t for t, c in zip(tokens, covered) if not c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def stays(page_id, url, host, marked, own, other):
        return [] if removing.value[page_key(host, marked, own) % _FILTER] else [(page_id, url, own)]

    def loses(page_id, url, host, marked, own, other):
        key = page_key(host, marked, own)
        return [(page_id, url, own, marked, key)] if removing.value[key % _FILTER] else []

    out = read_pages(pages, stays, "page_id long, url string, text string")
    if flags.any():
        rest = read_pages(pages, loses, "page_id long, url string, own string, marked boolean, page long").join(marks, "page", "left")
        out = out.unionByName(rest.select("page_id", "url", "own", "marked", "starts").mapInArrow(unique, "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

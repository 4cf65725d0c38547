"""Operator 1: suffix-array deduplication of repeated byte strings by external induced sorting.

Every byte is removed that some ``MIN_MATCH``-byte string covers which also starts at another place of the
corpus (another document, or elsewhere in the same one).  The corpus is the input as it stands.

Only a sample of suffixes is sorted; the others' order is induced from it, as in induced sorting.

* Sampling.  Each ``MIN_MATCH``-byte window names the place of its smallest ``ANCHOR``-byte hash (the last of
  equals).  Equal windows name the same place in them, so comparing the suffixes around equal anchors
  misses no match.  An anchor's windows start at 0 .. ``MIN_MATCH - ANCHOR`` bytes before it.
* Naming.  Anchors are grouped by their hash, then by the hash of all bytes their windows cover (their
  context).  A context seen twice is repeated throughout; an anchor hash with a single context seen once is
  not.  Both are aggregates, so thousands of copies never meet.
* Sorting and inducing.  Contexts that share an anchor hash but differ are sorted by the suffix that starts at
  the anchor (Spark's external sort by group), with the common prefix of neighbours.  The order of the
  suffixes one byte further left is induced: a priority queue takes (group, byte, rank) with the suffix and
  its common prefix, and gives them back in the new order, where neighbours of equal byte have one plus the
  smallest common prefix between them.  The queue spills sorted runs to disk beyond its memory limit.
  A window is repeated when its suffix has ``MIN_MATCH`` bytes in common with a neighbour.
* Hot groups.  An anchor hash with more than ``HOT`` different contexts (a passage or line that is common to
  many documents) would be one large group.  Its contexts are cut into cells of ``CELL`` windows: equal cells
  are repeated, and only where different cells share their inner bytes are single windows hashed and counted.

A document is known by (doc_id, 16 bits of its text's hash).  Hashes decide equality with 128 bits together
(anchor and context), or with the bytes themselves in the sort; a hot group's windows have 64 bits and their group.

Defined cases: null and empty texts have no bytes (n_bytes 0, sha256 of nothing); texts shorter than
``MIN_MATCH`` lose nothing; null doc_ids take part; rows repeated in full repeat each other's bytes, so all of them
lose them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import cut

MIN_MATCH = 200
ANCHOR = 32
HOT = 512
CELL = 13
BATCH_ROWS = 60_000
QUEUE_ROWS = 1_000_000
_SEGMENT = 1 << 19
_PLACE = np.uint64(0xFFFFF)
_ROUNDS = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes that start at each place, by doubling the length."""
    h, n, i = _ROUNDS[0][data], 1, 0
    while n < ANCHOR:
        h = h[:-n] * _ROUNDS[1][i] + h[n:]
        h ^= h >> np.uint64(29)
        n, i = 2 * n, i + 1
    return h * _ROUNDS[1][i]


def anchors(data: np.ndarray, min_match: int = MIN_MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of the anchors of a text's bytes; windows are named by their start."""
    found = []
    for at in range(0, max(1, len(data) - min_match + 1), _SEGMENT):
        part = data[at:at + _SEGMENT + min_match - 1]
        if len(part) < min_match:
            continue
        h = _anchor_hashes(part)
        width = min_match - ANCHOR + 1
        value = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        blocks = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
        blocks[:len(h)] = value
        blocks = blocks.reshape(-1, width)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[:len(h) - width + 1], head[width - 1:len(h)])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        place = (_PLACE - (least[first] & _PLACE)).astype(np.int64)
        found.append((h[place], place + at, first + at, last + at))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, doc (64 bits of the id and the text, by which the job knows a document), fp (16 more bits of the text), text as bytes."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"),
                       F.hash(text).bitwiseAND(0xFFFF).cast("int").alias("fp"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))


def _anchor_rows(docs: DataFrame, min_match: int, placed: bool) -> DataFrame:
    """kmer, ctx, and if ``placed`` doc and spot: first window << 32 | (last - first) << 24 | (place - first) << 16 | fp."""
    fields = [("kmer", pa.int64()), ("ctx", pa.int64())] + [("doc", pa.int64()), ("spot", pa.int64())] * placed
    kind = pa.schema(fields)

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for doc, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py()
                if len(raw) < min_match:
                    continue
                h, place, first, last = anchors(np.frombuffer(raw, np.uint8), min_match)
                edge = (place - first).astype(np.uint64)
                ctx = np.array([xxhash.xxh3_64_intdigest(raw[a:b + min_match]) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64)
                cols = [h.view(np.int64), (ctx + edge * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)]
                if placed:
                    spot = first << 32 | (last - first) << 24 | (place - first) << 16 | fp
                    cols += [pa.array([doc] * len(h), pa.int64()), spot]
                out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=kind))
                held += len(h)
                if held > 50_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, held = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return _plain(docs).select("doc", "fp", "text").mapInArrow(run, "kmer long, ctx long" + ", doc long, spot long" * placed)


class SpillQueue:
    """A priority queue of tuples held as columns, ordered by the first; beyond ``limit`` rows it keeps sorted runs on disk."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.held, self.rows, self.runs = limit, [], 0, []  # a run: file name, number of columns

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.rows += len(columns[0])
        if self.rows > self.limit:
            self._spill()

    def _sorted(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held)]
        order = np.argsort(columns[0], kind="stable")
        self.held, self.rows = [], 0
        return [c[order] for c in columns]

    def _spill(self) -> None:
        columns = self._sorted()
        with tempfile.NamedTemporaryFile(suffix=".run", delete=False) as f:
            for c in columns:
                np.save(f, c)
        self.runs.append((f.name, len(columns)))

    def pop_all(self) -> list[np.ndarray]:
        """Every tuple in order (ties in the order of pushing); empties the queue and its files."""
        parts = []
        for name, width in self.runs:
            with open(name, "rb") as f:
                parts.append([np.load(f) for _ in range(width)])
            os.unlink(name)
        self.runs = []
        if self.held:
            parts.append(self._sorted())
        if len(parts) == 1:
            return parts[0]
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")  # merges presorted runs
        return [c[order] for c in columns]


def _common_prefix(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(sizes_a, sizes_b))


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low .. high]) for each pair, low <= high."""
    if not len(low):
        return np.zeros(0, values.dtype)
    ends = np.minimum(high + 1, len(values) - 1)
    cut_points = np.empty(2 * len(low), dtype=np.int64)
    cut_points[0::2], cut_points[1::2] = low, ends
    least = np.minimum.reduceat(values, cut_points)[0::2]
    return np.where(high == len(values) - 1, np.minimum(least, values[-1]), least)


def induce(groups: np.ndarray, contexts: list[bytes], edges: np.ndarray, min_match: int = MIN_MATCH, queue_rows: int = QUEUE_ROWS) -> np.ndarray:
    """For contexts with their anchor at byte ``edges`` of them, and equal ``groups`` together: n x windows, whether the
    window that starts o bytes before the anchor is repeated in the group."""
    n, width = len(contexts), min_match - ANCHOR + 1
    repeated = np.zeros((n, width), dtype=bool)
    if n < 2:
        return repeated
    right_size = np.array([len(c) for c in contexts]) - edges
    rights = np.zeros((n, min_match), dtype=np.uint8)
    lefts = np.zeros((n, width), dtype=np.uint8)
    for i, (c, e) in enumerate(zip(contexts, edges.tolist())):
        raw = np.frombuffer(c, np.uint8)
        rights[i, :len(c) - e] = raw[e:e + min_match]
        lefts[i, :e] = raw[:e][::-1]
    # the sampled suffixes in order: group, then bytes from the anchor on
    words = rights.view(">u8").reshape(n, -1)
    rank = np.lexsort([*words.T[::-1], groups])
    lcp = np.zeros(n, dtype=np.int64)
    a, b = rank[:-1], rank[1:]
    lcp[1:] = np.where(groups[a] == groups[b], _common_prefix(rights[a], rights[b], right_size[a], right_size[b]), -1)
    lcp[0] = -1
    queue = SpillQueue(queue_rows)
    _, dense = np.unique(groups, return_inverse=True)
    for o in range(width):
        beside = np.maximum(lcp, np.append(lcp[1:], -1))
        live = (beside >= min_match) & (o <= edges[rank]) & (right_size[rank] + o >= min_match)
        repeated[rank[live], o] = True
        # suffixes that can go on: a byte to the left, and a neighbour that may still reach the length
        on = np.flatnonzero((edges[rank] > o) & (beside >= 0) & (beside + edges[rank] - o >= min_match))
        if len(on) < 2:
            break
        lcp = np.minimum.reduceat(lcp[:on[-1] + 1], np.concatenate(([0], on[:-1] + 1)))
        rank = rank[on]
        queue.push(dense[rank].astype(np.int64) << 8 | lefts[rank, o], np.arange(len(rank)))
        key, old = queue.pop_all()
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        grown = np.full(len(rank), -1, dtype=np.int64)
        grown[np.flatnonzero(key[1:] >> 8 == key[:-1] >> 8) + 1] = 0
        least = _range_min(lcp, old[same - 1] + 1, old[same])
        grown[same] = np.where(least >= 0, least + 1, -1)
        rank, lcp = rank[old], grown
    return repeated


def _contexts(docs: DataFrame, wanted: DataFrame, min_match: int) -> DataFrame:
    """``wanted`` (kmer, n, doc, spot) with ``edge`` and ``bytes`` of the context."""
    by_doc = wanted.groupBy("doc", F.col("spot").bitwiseAND(0xFFFF).cast("int").alias("fp")).agg(
        F.collect_list(F.struct("kmer", "hot", "n", "spot")).alias("spots"))
    texts = _packed(docs).withColumnsRenamed({"doc": "_id", "fp": "_fp"})
    kind = pa.schema([("kmer", pa.int64()), ("hot", pa.bool_()), ("n", pa.int64()), ("doc", pa.int64()), ("spot", pa.int64()),
                      ("edge", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = {k: [] for k in kind.names}
            for doc, spots, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = unpack(text.as_py())
                for s in spots:
                    first, more, edge = s["spot"] >> 32, s["spot"] >> 24 & 255, s["spot"] >> 16 & 255
                    for k, v in zip(rows, (s["kmer"], s["hot"], s["n"], doc, s["spot"], edge, raw[first:first + more + min_match])):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    joined = by_doc.join(texts, (by_doc["doc"] == texts["_id"]) & (by_doc["fp"] == texts["_fp"]))
    return joined.select("doc", "spots", "text").mapInArrow(
        run, "kmer long, hot boolean, n long, doc long, spot long, edge int, bytes binary").dropDuplicates(
        ["kmer", "doc", "spot"])  # repeated rows bring a context again


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, doc, fp and the text compressed, for shuffles."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(t.as_py()) for t in batch.column(3)], pa.binary())],
                                             names=["doc_id", "doc", "fp", "text"])
    return _plain(docs).mapInArrow(run, "doc_id long, doc long, fp int, text binary")


def _spans_of(doc, spot: int, offsets: np.ndarray, min_match: int) -> list[tuple]:
    """Spans of the repeated windows that start ``offsets`` (ascending) bytes before an anchor."""
    place = (spot >> 32) + (spot >> 16 & 255)
    breaks = np.flatnonzero(np.diff(offsets) > 1)
    starts, ends = offsets[np.append(0, breaks + 1)], offsets[np.append(breaks, len(offsets) - 1)]
    return [(doc, spot & 0xFFFF, place - int(b), place - int(a) + min_match) for a, b in zip(starts, ends)]


_SPANS = pa.schema([("doc", pa.int64()), ("fp", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _induced_spans(contexts: DataFrame, min_match: int, queue_rows: int) -> DataFrame:
    """Repeated spans of the contexts seen once, by sorting and inducing within each anchor hash."""
    def run(batches):
        held: list = []

        def solve(rows):
            found = induce(np.array([r[0] for r in rows]), [r[5] for r in rows], np.array([r[4] for r in rows]), min_match, queue_rows)
            spans = []
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                if rows[i][1] == 1:
                    spans += _spans_of(rows[i][2], rows[i][3], np.flatnonzero(found[i]), min_match)
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], f.type) for k, f in enumerate(_SPANS)], schema=_SPANS)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(held) >= BATCH_ROWS and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return contexts.select("kmer", "n", "doc", "spot", "edge", "bytes").repartition("kmer").sortWithinPartitions("kmer").mapInArrow(
        run, "doc long, fp int, start long, end long")


def _hot_cells(contexts: DataFrame, min_match: int) -> DataFrame:
    """Hot contexts cut into cells of ``CELL`` window offsets: kmer, cell, inner (hash of the bytes that all windows of the
    cell share), whole (hash of the bytes of this context's windows in it), n, doc, spot, low and high offset, bytes."""
    kind = pa.schema([("kmer", pa.int64()), ("cell", pa.int32()), ("inner", pa.int64()), ("whole", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()),
                      ("spot", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in kind.names}
            for kmer, n, doc, spot, edge, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                first = edge - (len(raw) - min_match)
                for cell in range(first // CELL, edge // CELL + 1):
                    low, high = max(first, cell * CELL), min(edge, cell * CELL + CELL - 1)
                    part = raw[edge - high:edge - low + min_match]
                    inner = raw[edge - cell * CELL:edge - (cell * CELL + CELL - 1) + min_match]
                    for k, v in zip(rows, (kmer, cell, xxhash.xxh3_64_intdigest(inner) - (1 << 63),
                                           xxhash.xxh3_64_intdigest(part, low * 256 + high) - (1 << 63), n, doc, spot, low, high, part)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    return contexts.select("kmer", "n", "doc", "spot", "edge", "bytes").mapInArrow(
        run, "kmer long, cell int, inner long, whole long, n long, doc long, spot long, low int, high int, bytes binary")


def _hot_spans(contexts: DataFrame, min_match: int) -> DataFrame:
    """Repeated spans of the contexts of hot anchor hashes, by aggregates alone.

    Equal cells are repeated throughout, cells whose shared bytes occur once are not; in the others, each
    different cell's windows are hashed and counted."""
    def windows(batches):
        kind = pa.schema([("kmer", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("spot", pa.int64()), ("o", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            rows = {k: [] for k in kind.names}
            for kmer, n, doc, spot, high, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for p in range(len(raw) - min_match + 1):
                    h = xxhash.xxh3_64_intdigest(raw[p:p + min_match], high - p) - (1 << 63)
                    for k, v in zip(rows, (kmer, h, doc, spot, high - p, n)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    def spans(batches):
        for batch in batches:
            out = [s for doc, spot, o in zip(*(batch.column(i).to_pylist() for i in range(3))) for s in _spans_of(doc, spot, np.array(o), min_match)]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in out], f.type) for k, f in enumerate(_SPANS)], schema=_SPANS)

    cells = cut(_hot_cells(contexts, min_match), "suffix-cells")
    key = ["kmer", "cell", "inner", "whole"]
    different = cut(cells.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "spot", "high")).alias("one"), F.first("bytes").alias("bytes")),
                    "suffix-different")
    place = F.shiftright("spot", 32) + F.shiftright("spot", 16).bitwiseAND(255)
    equal = cells.where("n = 1").join(different.where("n > 1").select(*key), key).select(
        "doc", F.col("spot").bitwiseAND(0xFFFF).cast("int").alias("fp"), (place - F.col("high")).alias("start"), (place - F.col("low") + min_match).alias("end"))
    open_cells = different.groupBy("kmer", "cell", "inner").agg(F.count(F.lit(1)).alias("several"), F.min("n").alias("least")).where("several > 1 and least = 1")
    each = different.join(open_cells, ["kmer", "cell", "inner"]).select("kmer", "n", "one.doc", "one.spot", "one.high", "bytes").mapInArrow(
        windows, "kmer long, window long, doc long, spot long, o int, n long")
    often = each.groupBy("kmer", "window").agg(F.sum("n").alias("times")).where("times > 1").select("kmer", "window")
    return equal.unionByName(each.where("n = 1").join(often, ["kmer", "window"]).groupBy("doc", "spot").agg(
        F.sort_array(F.collect_list("o")).alias("o")).mapInArrow(spans, "doc long, fp int, start long, end long"))


def repeated_spans(docs: DataFrame, min_match: int = MIN_MATCH, hot: int = HOT, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """doc, fp, start, end: byte spans that repeated strings cover; spans may overlap."""
    names = cut(_anchor_rows(docs, min_match, False).groupBy("kmer").agg(
        F.count(F.lit(1)).alias("times"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("times > 1")
        .select("kmer", (F.col("a") != F.col("b")).alias("several")), "suffix-names")
    rows = cut(_anchor_rows(docs, min_match, True).join(names, "kmer"), "suffix-anchors")
    span = [F.col("spot").bitwiseAND(0xFFFF).cast("int").alias("fp"), F.shiftright("spot", 32).alias("start"),
            (F.shiftright("spot", 32) + F.shiftright("spot", 24).bitwiseAND(255) + min_match).alias("end")]
    whole = rows.where("not several").select("doc", *span)

    differ = rows.where("several")
    named = cut(differ.groupBy("kmer", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "spot")).alias("one")), "suffix-contexts")
    copied = differ.join(named.where("n > 1").select("kmer", "ctx"), ["kmer", "ctx"]).select("doc", *span)
    # a kmer is repeated, so all of its rows count; those whose contexts are one in number have no others to meet
    sizes = named.groupBy("kmer").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1")
    wanted = named.join(sizes, "kmer").select("kmer", (F.col("size") > hot).alias("hot"), "n", "one.doc", "one.spot")
    contexts = cut(_contexts(docs, wanted, min_match), "suffix-bytes")
    return (whole.unionByName(copied).unionByName(_induced_spans(contexts.where("not hot"), min_match, queue_rows))
            .unionByName(_hot_spans(contexts.where("hot"), min_match)))


def remove_repeats(docs: DataFrame, min_match: int = MIN_MATCH, hot: int = HOT, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs), kept (remaining bytes) for every row of ``docs``."""
    spans = repeated_spans(docs, min_match, hot, queue_rows).groupBy("doc", "fp").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc": "_id", "fp": "_fp"})
    texts = _packed(docs)
    joined = texts.join(spans, (texts["doc"] == spans["_id"]) & (texts["fp"] == spans["_fp"]), "left").select("doc_id", "text", "spans")
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                      ("kept", pa.binary())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = {k: [] for k in kind.names}
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw, runs = unpack(text.as_py()), []
                for s in sorted(found or [], key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append({"start": s["start"], "end": s["end"]})
                edges = [0, *[x for r in runs for x in (r["start"], r["end"])], len(raw)]
                for k, v in zip(rows, (doc, len(raw), runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def brute_force(texts: list[bytes], min_match: int) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text, by counting every string; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - min_match + 1):
            key = hashlib.md5(t[p:p + min_match]).digest()
            count[key] = count.get(key, 0) + 1
    out = []
    for t in texts:
        runs: list[list[int]] = []
        for p in range(len(t) - min_match + 1):
            if count[hashlib.md5(t[p:p + min_match]).digest()] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + min_match
                else:
                    runs.append([p, p + min_match])
        out.append([tuple(r) for r in runs])
    return out

"""Operator 3: toxic passages by maximum-scoring segments.

Learning counts, over labelled documents, in how many toxic and other documents each token feature
occurs (a word and, for longer words, its first four letters; features are hashed to a fixed number
of buckets).  A feature's score is the lower bound of its log-odds under an informative Dirichlet
prior, so features seen a few times count for little; all other tokens carry a small negative score.
Candidate features are then counted by their distinct left neighbours instead of by documents, so
that near copies of one text count about once.
A linear-time scan over a document's token scores finds every maximal scoring segment.  Segment
scores become expected chance counts by extreme-value theory (lambda from the null score
distribution, K from the segments of non-toxic documents); the document's evidence is the sum of
-log E over its significant segments, and a logistic curve fitted on labelled documents that the
table was not learned from turns evidence into a score.

Defined cases: null and empty texts have no segment and get the score of no evidence; documents
without a label, null ids, repeated rows and extra columns are scored like any other; an empty label
table gives every text the score 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.llm.common import Memo, below, id_fold

BUCKETS = 1 << 20
LEAST = 2.5
FLOOR = 0.5
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


@dataclass
class ToxicityModel:
    """Bounded: at most ``BUCKETS`` scores, however large the corpus."""
    scores: dict[int, float] = field(default_factory=dict)
    neutral: float = -0.3
    lam: float = 1.0
    k: float = 1.0
    bias: float = -50.0
    slope: float = 0.0


def features(word: str) -> list[int]:
    """Buckets of a token: the word, and its first four letters if it is longer than that."""
    w = _EDGE.sub("", word.lower())
    if not w:
        return []
    keys = [w] if len(w) < 5 else [w, w[:4] + "*"]
    return [zlib.crc32(k.encode()) % BUCKETS for k in keys]


def dirichlet_scores(counts: list[tuple[int, int, int]], n_toxic: int, n_other: int,
                     strength: float = 2.0, z: float = 1.64, least: float = LEAST) -> dict[int, float]:
    """Lower bounds, above ``least``, of the log ratio of the rates of (bucket, other, toxic) counts."""
    total, out = n_toxic + n_other, {}
    for bucket, y0, y1 in counts:
        prior = (y0 + y1) / total
        a = strength * prior + FLOOR
        odds = math.log((y1 + a) / (n_toxic + strength)) - math.log((y0 + a) / (n_other + strength))
        low = odds - z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if low > least:
            out[bucket] = low
    return out


def maximal_segments(index: list[int], gain: list[float], neutral: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last, score) of a sequence whose tokens at ``index`` score
    ``gain`` (positive) and all others ``neutral`` (negative).  Linear in the number of gains: each
    candidate remembers the nearest earlier one with a smaller left sum."""
    runs: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, earlier candidate
    total, before = 0.0, -1
    for i, g in zip(index, gain):
        left = total + neutral * (i - before - 1)
        total, before = left + g, i
        first, right = i, total
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][0] >= left:
                j = runs[j][4]
            if j < 0 or runs[j][1] >= right:
                runs.append((left, right, first, i, j))
                break
            left, first = runs[j][0], runs[j][2]
            del runs[j:]
    return [(a, b, r - l) for l, r, a, b, _ in runs]


class Scanner:
    """Token scores of a text, through a bounded memo of words."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.memo = Memo(lambda w: max((model.scores.get(b, 0.0) for b in features(w)), default=0.0))

    def values(self, text: str | None) -> tuple[list[str], np.ndarray]:
        words = (text or "").split()
        return words, np.fromiter(map(self.memo.__getitem__, words), dtype=float, count=len(words))

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        words, values = self.values(text)
        at = np.flatnonzero(values)
        return maximal_segments(at.tolist(), values[at].tolist(), self.model.neutral), len(words)

    def gains(self, text: str | None) -> list[float]:
        """Positive scores of a text's distinct words, so that one repeated word is one gain."""
        words, values = self.values(text)
        return [self.memo[w] for w in {words[i] for i in np.flatnonzero(values)}]

    def evidence(self, segments, n: int) -> tuple[float, list]:
        m = self.model
        kept = [(a, b, s) for a, b, s in segments if m.lam * s > math.log(m.k * max(n, 1))]
        return sum(m.lam * s - math.log(m.k * max(n, 1)) for _, _, s in kept), kept


def _labelled(docs: DataFrame, labels: DataFrame, max_docs: int, holdout_mod: int) -> DataFrame:
    """Training documents with label: a bounded hash sample of the labelled ids, so it can be broadcast."""
    train = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_fold("doc_id", holdout_mod) != 0))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = train.count()
    if n > max_docs:
        train = train.where(below(max_docs / n, "doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").withColumn(
        "half", (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / holdout_mod) % 2).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 40_000, holdout_mod: int = 5) -> ToxicityModel:
    """Learn from at most about ``max_docs`` labelled rows whose id is not in held-out fold 0.

    Scores are learned from all of them; for the calibration each half of them is scanned with the scores of
    the other half.  What reaches the driver is bounded: counts per bucket, one row of segments per sampled row."""
    rows = _labelled(docs, labels, max_docs, holdout_mod)
    learn = rows.dropDuplicates(["text"]).select("text", "toxic", "half")

    def count(batches):
        seen = {(half, toxic): Counter() for half in (0, 1) for toxic in (0, 1)}
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen[half, toxic].update({-1} | {b for w in set((text or "").split()) for b in features(w)})
        for half in (0, 1):
            other, bad = seen[half, 0], seen[half, 1]
            keys = list(other.keys() | bad.keys())
            yield pa.RecordBatch.from_pydict({"bucket": keys, "half": [half] * len(keys), "other": [other[k] for k in keys], "toxic": [bad[k] for k in keys]},
                                             schema=pa.schema([("bucket", pa.int32()), ("half", pa.int32()), ("other", pa.int64()), ("toxic", pa.int64())]))

    def tables(counts: DataFrame) -> list[dict[int, tuple[int, int]]]:
        """(other, toxic) by bucket: of half 0, half 1, and both, for buckets with enough toxic rows."""
        sums = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("other", "toxic")]
        found = counts.groupBy("bucket").agg(*sums).where("bucket = -1 or toxic0 + toxic1 >= 3").collect()
        return [{r.bucket: (r.other0, r.toxic0) for r in found}, {r.bucket: (r.other1, r.toxic1) for r in found},
                {r.bucket: (r.other0 + r.other1, r.toxic0 + r.toxic1) for r in found}]

    def scores(table, totals, least):
        return dirichlet_scores([(b, *n) for b, n in table.items() if b != -1], totals[1], totals[0], least=least)

    by_rows = tables(learn.mapInArrow(count, "bucket int, half int, other long, toxic long"))
    totals = [t.get(-1, (0, 0)) for t in by_rows]
    model = ToxicityModel()
    if not all(totals[2]):
        return model
    first = set().union(*(scores(t, n, 1.0) for t, n in zip(by_rows, totals) if all(n)))

    def neighbours(batches):
        seen = set()
        memo = Memo(lambda w: [b for b in features(w) if b in first])
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or "").split()
                for before, w in zip(["", *words], words):
                    for b in memo[w]:
                        seen.add((b, half, toxic, zlib.crc32(before.encode())))
        kind = pa.schema([("bucket", pa.int32()), ("half", pa.int32()), ("toxic", pa.int32()), ("before", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], f.type) for i, f in enumerate(kind)], schema=kind)

    by_neighbour = tables(learn.mapInArrow(neighbours, "bucket int, half int, toxic int, before long").distinct()
                          .select("bucket", "half", (1 - F.col("toxic")).alias("other"), "toxic"))
    model.scores, halves = scores(by_neighbour[2], totals[2], LEAST), [
        scores(t, n, LEAST) if all(n) else {} for t, n in zip(by_neighbour, totals)]

    def scan(batches):
        scanners = [Scanner(ToxicityModel(scores=halves[1 - half])) for half in (0, 1)]
        for batch in batches:
            texts, half = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = [scanners[h].segments(t) for t, h in zip(texts, half)]
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch.column(1).cast(pa.int32()), "n": [n for _, n in found], "best": [[s for _, _, s in x] for x, _ in found],
                 "gains": [scanners[h].gains(t) for t, h in zip(texts, half)]},
                schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.list_(pa.float64())), ("gains", pa.list_(pa.float64()))]))

    held = rows.select("text", "toxic", "half").mapInArrow(scan, "toxic int, n long, best array<double>, gains array<double>").collect()
    calibrate(model, [(r.toxic, r.n, r.best, r.gains) for r in held])
    return model


def calibrate(model: ToxicityModel, rows: list[tuple[int, int, list[float], list[float]]]) -> None:
    """Extreme-value parameters from the non-toxic rows, then the logistic curve from all rows.
    Rows: toxic, tokens, segment scores, gains of distinct words."""
    null = [(n, best, gains) for toxic, n, best, gains in rows if not toxic]
    tokens = max(1, sum(n for n, _, _ in null))
    gains = np.array([g for _, _, x in null for g in x] or [max(model.scores.values(), default=1.0)])
    # lambda is the positive root of E[exp(lambda * score)] = 1 over the tokens of non-toxic rows
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        if np.exp(np.minimum(mid * gains, 600)).sum() / tokens + (1 - len(gains) / tokens) * math.exp(mid * model.neutral) > 1:
            high = mid
        else:
            low = mid
    model.lam = low
    # K from the expected number of chance segments: one per gain of a non-toxic row
    model.k = len(gains) / tokens * math.exp(model.lam * float(gains.min()))
    scanner = Scanner(model)
    x = np.array([math.log1p(scanner.evidence([(0, 0, s) for s in best], n)[0]) for _, n, best, _ in rows])
    y = np.array([t for t, _, _, _ in rows], dtype=float)
    w = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.bias, model.slope = float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score double, evidence double, passages array<struct<first, last, score>> (token positions)."""
    if {"score", "evidence", "passages"} & set(docs.columns):
        raise ValueError("docs already holds an output column")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            points, evidence, passages = [], [], []
            for text in batch.column(at).to_pylist():
                e, kept = scanner.evidence(*scanner.segments(text))
                z = model.bias + model.slope * math.log1p(e)
                points.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
                evidence.append(e)
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in kept])
            cols = [pa.array(points, pa.float64()), pa.array(evidence, pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "score", "evidence", "passages"])

    added = T.StructType.fromDDL("score double, evidence double, passages array<struct<first:int,last:int,score:double>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))

"""Text metrics for open_text tasks (M5-M9): BLEU-4, ROUGE-1/2 and ROUGE-L on whole texts.

BLEU's tokenisation is native (JVM regexes, so the DuckDB oracle sees the same tokens).  Overlap
counting has two plans with identical results:

* ``impl="arrow"`` (default): one Arrow UDF computes the token counts, the clipped n-gram
  counts (BLEU n=1..4, ROUGE n=1..2) and the LCS length.  Row-local: no shuffle at all.  Each side comes as one
  string, BLEU tokens joined by spaces and the lower-cased text for ROUGE; tokens are numbered and n-grams are counted by
  sorting, for slices of a batch at once.
* ``impl="native"`` (for tests): explode n-grams of both sides, ``groupBy(key, family, n, gram)`` then ``groupBy(key, family, n)``; hash partitioning on
  the key satisfies both groupings, so the only shuffle moves whole rows.  JVM-only but the
  higher-order functions that build grams are interpreted: ~37 s on the same input.

ROUGE-L needs the LCS length.  It runs in the same Arrow step with the bit-parallel
LCS recurrence (O(|a| * |b| / 64) word operations, exact), so whole documents of tens of
thousands of tokens are fine.  Only the features of the wanted metrics are computed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import exact_sum, f_measure, safe_div
from ..functions.stem import rouge_stem_tokens, stem_words
from ..functions.text import bleu_tokens, py_strip, rouge_tokens

CELL = ["model", "split", "shot"]
PAIR_KEY = ["model", "split", "shot", "identifier"]
BLEU_ORDER = 4


# ------------------------------------------------------------------ LCS

def lcs_length(a, b) -> int:
    """Exact LCS length by the bit-vector recurrence V' = (V + (V & M)) | (V & ~M)."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return 0
    found = set(b)
    a = [tok for tok in a if tok in found]  # tokens of one side only match nothing
    found = set(a)
    b = [tok for tok in b if tok in found]
    n, m = len(a), len(b)
    if m < n:  # bits over the longer side, Python loop over the shorter one
        a, b, n, m = b, a, m, n
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << m) - 1
    v = full
    for i, tok in enumerate(a):
        u = v & masks[tok]
        v = (v + u) | (v - u)
        if not i & 63:  # bits above the text's end carry upwards only
            v &= full
    return m - (v & full).bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), dtype=np.int32)
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        out[i] = lcs_length(list(x), list(y))
    return pd.Series(out)


_FEATURES = ["b1_clip", "b2_clip", "b3_clip", "b4_clip", "r1_clip", "r2_clip", "lcs"]


# what each metric needs of the features
NEEDS = {"bleu": _FEATURES[:4], "rouge1": ["r1_clip"], "rouge2": ["r2_clip"], "rougeL": ["lcs"]}
METRICS = list(NEEDS)


LENGTHS = ["pb", "rb", "pr", "rr"]  # token counts: prediction and reference, BLEU and ROUGE
_SLICE_BYTES = 8 << 20  # text of all sides that is counted at once: some 50 bytes of memory for each of it
_ROUGE_BYTES = np.full(256, 32, dtype=np.uint8)  # every byte but a-z and 0-9 separates tokens
_ROUGE_BYTES[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]


def _spaced(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with a space in place of each byte that belongs to no ROUGE token."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    new = _ROUGE_BYTES[np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]]] if data else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(new))


def _numbered(sides: list[pa.Array], stem: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token numbers of all texts of all sides, the row of each, token counts of each side).  ``sides``: tokens between spaces."""
    lists = [pc.split_pattern(x, " ") for x in sides]
    tokens = pa.concat_arrays([x.flatten() for x in lists])
    row = np.concatenate([np.repeat(np.arange(len(x)) + k * len(x), pc.list_value_length(x).to_numpy()) for k, x in enumerate(lists)])
    held = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
    encoded = tokens.dictionary_encode()
    ids, row = encoded.indices.to_numpy()[held].astype(np.int64), row[held]
    if stem:
        ids = pa.array(rouge_stem_tokens(encoded.dictionary.to_pylist()), pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)[ids]
    n = len(sides[0])
    sizes = np.bincount(row, minlength=n * len(sides))
    return ids, row, [sizes[k * n:(k + 1) * n] for k in range(len(sides))]


def _clips(ids: np.ndarray, row: np.ndarray, n_rows: int, orders: list[int]) -> dict[int, np.ndarray]:
    """For each order, the sum over grams of min(count in prediction, count in reference) of each row.  Texts 0 to
    n_rows - 1 are predictions, those from ``n_rows`` on the references."""
    n_ids = int(ids.max()) + 1 if len(ids) else 1

    def follow(of: np.ndarray, then: np.ndarray, n_then: int, order: int) -> np.ndarray:
        """One number for a gram of ``order`` tokens: ``of`` at its first and ``then`` at its end; -1 where the text ends before."""
        size = max(len(row) - order + 1, 0)
        return np.where(row[:size] == row[order - 1:], of[:size] * n_then + then[-size or len(then):], -1)

    grams = {1: (ids, n_ids)}
    if max(orders) > 1:
        grams[2] = (follow(ids, ids, n_ids, 2), n_ids * n_ids)
    if max(orders) > 2:  # pairs numbered without gaps: no number of a row's gram exceeds 64 bits in a slice
        pairs, number = np.unique(grams[2][0], return_inverse=True)
        first = np.searchsorted(pairs, 0)  # -1 comes first
        n_pairs = max(len(pairs) - first, 1)
        grams[2] = (number - first, n_pairs)
        grams[3] = (follow(grams[2][0], ids, n_ids, 3), n_pairs * n_ids)
        grams[4] = (follow(grams[2][0], grams[2][0], n_pairs, 4), n_pairs * n_pairs)
    out = {}
    for order in orders:
        gram, n = grams[order]
        held = gram >= 0
        own = row[:len(gram)][held]
        if not len(own):
            out[order] = np.zeros(n_rows, dtype=np.int64)
            continue
        keys = np.sort((own % n_rows * n + gram[held]) << 1 | (own >= n_rows))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] >> 1 != keys[:-1] >> 1)))
        refs = np.add.reduceat(keys & 1, first)
        both = np.minimum(refs, np.diff(np.append(first, len(keys))) - refs)
        found = both > 0
        out[order] = np.bincount((keys[first[found]] >> 1) // n, both[found], n_rows).astype(np.int64)
    return out


def _slices(sides: list[pa.Array]):
    """Runs of rows of about ``_SLICE_BYTES``, a row at least."""
    size = sum(pc.binary_length(x).to_numpy().astype(np.int64) for x in sides) + 64  # which bounds the rows of a slice, too
    start, held = 0, 0
    for i, x in enumerate(size.tolist()):
        if i > start and held + x > _SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += x
    yield start, len(size) - start


def _features(pb: pa.Array, rb: pa.Array, pr: pa.Array, rr: pa.Array, wanted: list[str], stem: bool) -> dict[str, np.ndarray]:
    n = len(pb)
    out = {}
    bleu, rouge = [int(f[1]) for f in wanted if f[0] == "b"], [int(f[1]) for f in wanted if f[0] == "r"]
    ids, row, (out["pb"], out["rb"]) = _numbered([pb, rb])
    if bleu:
        out |= {f"b{k}_clip": v for k, v in _clips(ids, row, n, bleu).items()}
    ids, row, (out["pr"], out["rr"]) = _numbered([_spaced(pr), _spaced(rr)], stem)
    if rouge:
        out |= {f"r{k}_clip": v for k, v in _clips(ids, row, n, rouge).items()}
    if "lcs" in wanted:
        texts = np.split(ids, np.cumsum(np.concatenate((out["pr"], out["rr"])))[:-1])
        out["lcs"] = np.array([lcs_length(texts[n + i].tolist(), texts[i].tolist()) for i in range(n)], dtype=np.int64)
    return out


def _overlap_udf(wanted: list[str], stem: bool):
    """An Arrow UDF of the four sides (BLEU tokens joined by spaces, lower-cased texts for ROUGE; no nulls) that gives the
    token counts and the ``wanted`` features."""
    names = LENGTHS + wanted

    def overlap(pb: pa.Array, rb: pa.Array, pr: pa.Array, rr: pa.Array) -> pa.Array:
        parts = [_features(*[x.slice(start, n).cast(pa.string()) for x in (pb, rb, pr, rr)], wanted, stem) for start, n in _slices([pb, rb, pr, rr])] if len(pb) else []
        columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in names]
        return pa.StructArray.from_arrays(columns, names=names)

    overlap.__name__ = "overlap_" + "_".join(f.removesuffix("_clip") for f in wanted)
    return F.arrow_udf(overlap, T.StructType([T.StructField(c, T.LongType()) for c in names]))


def lcs(a: Column, b: Column) -> Column:
    """LCS length of two token arrays (Arrow batch UDF)."""
    return _lcs_udf(a, b)


# ------------------------------------------------------------------ n-gram counting

def _ngrams(tokens: Column, n: int) -> Column:
    """n-grams of a token array as space-joined strings (tokens never hold spaces)."""
    k = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(k >= 1, grams).otherwise(F.array().cast("array<string>"))


def _tagger(fam: str, n: int, side: str):
    """struct(fam, n, g, cp, cr) for one gram of one side."""
    def tag(g):
        return F.struct(
            F.lit(fam).alias("fam"), F.lit(n).alias("n"), g.alias("g"),
            F.lit(1 if side == "p" else 0).alias("cp"), F.lit(1 if side == "r" else 0).alias("cr"),
        )
    return tag


def _gram_stream(pred_bt: Column, ref_bt: Column, pred_rt: Column, ref_rt: Column) -> Column:
    """All (family, n, gram, side) entries of one pair: BLEU family 'b' n=1..4, ROUGE 'r' n=1..2."""
    parts = []
    for fam, p, r, orders in (("b", pred_bt, ref_bt, range(1, BLEU_ORDER + 1)), ("r", pred_rt, ref_rt, (1, 2))):
        for n in orders:
            for side, toks in (("p", p), ("r", r)):
                parts.append(F.transform(_ngrams(toks, n), _tagger(fam, n, side)))
    return F.concat(*parts)


def tokenize_pairs(pairs: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Add both tokenisations of both sides."""
    return (
        pairs.withColumn("pred_bt", bleu_tokens(F.col(pred)))
        .withColumn("ref_bt", bleu_tokens(F.col(ref)))
        .withColumn("pred_rt", rouge_tokens(F.col(pred)))
        .withColumn("ref_rt", rouge_tokens(F.col(ref)))
    )


def overlap_counts(tok: DataFrame, key: list[str]) -> DataFrame:
    """Per pair: clipped overlap and side totals for every (family, n), as one wide row."""
    grams = tok.select(*key, F.explode(_gram_stream(F.col("pred_bt"), F.col("ref_bt"), F.col("pred_rt"), F.col("ref_rt"))).alias("e"))
    per_gram = grams.groupBy(*key, "e.fam", "e.n", "e.g").agg(F.sum("e.cp").alias("cp"), F.sum("e.cr").alias("cr"))
    per_n = per_gram.groupBy(*key, "fam", "n").agg(F.sum(F.least("cp", "cr")).alias("clip"))
    aggs = []
    for fam, orders in (("b", range(1, BLEU_ORDER + 1)), ("r", (1, 2))):
        for n in orders:
            aggs.append(
                F.coalesce(F.sum(F.when((F.col("fam") == fam) & (F.col("n") == n), F.col("clip"))), F.lit(0))
                .cast("bigint").alias(f"{fam}{n}_clip")
            )
    return per_n.groupBy(*key).agg(*aggs)


def overlap_features(tok: DataFrame, key: list[str]) -> DataFrame:
    """Per pair: key, the four token arrays, b1..b4 / r1..r2 clipped counts and the LCS length, by exploded n-grams."""
    arrays = ["pred_bt", "ref_bt", "pred_rt", "ref_rt"]
    counts = overlap_counts(tok, key)
    j = tok.select(*key, *arrays, lcs(F.col("ref_rt"), F.col("pred_rt")).cast("bigint").alias("lcs")).join(counts, key, "left")
    return j.na.fill(0, [c for c in counts.columns if c.endswith("_clip")])


def with_text_scores(df: DataFrame, pred: Column, ref: Column, stem: bool = False, metrics: list[str] | None = None,
                     tokens: Callable[[Column], Column] = bleu_tokens) -> DataFrame:
    """Row-level M5-M8: add the wanted ``metrics`` (default all; ``rougeL`` brings ``lcs``) to ``df`` in one Arrow step.

    ``tokens``: BLEU's tokeniser, e.g. ``functions.treebank.treebank_tokens`` with its learned abbreviations; its tokens hold no
    spaces and are not empty."""
    wanted = metrics or METRICS
    features = [f for m in wanted for f in NEEDS[m]]
    empty = F.lit("")
    p, r = py_strip(pred), py_strip(ref)
    bleu, rouge = "bleu" in wanted, any(m != "bleu" for m in wanted)
    sides = {
        "pb": F.array_join(tokens(p), " ") if bleu else empty, "rb": F.array_join(tokens(r), " ") if bleu else empty,
        "pr": F.lower(p) if rouge else empty, "rr": F.lower(r) if rouge else empty,
    }
    j = df.withColumn("_f", _overlap_udf(features, stem)(*[F.coalesce(c, empty) for c in sides.values()]))
    scores = _score_columns(*[{c: F.col("_f." + c) for c in some} for some in (LENGTHS, features)], wanted)
    return j.select(*df.columns, *[c.alias(n) for n, c in scores.items()])


def _score_columns(length: dict, clip: dict, wanted: list[str]) -> dict:
    def total(side, n):
        return F.greatest(length[side] - n + 1, F.lit(0))

    def bleu():
        lp, lr = length["pb"], length["rb"]
        orders = range(1, BLEU_ORDER + 1)
        bp = F.when(lp > lr, F.lit(1.0)).when(lp == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - lr / lp))
        logsum = sum((F.log(clip[f"b{n}_clip"] / F.greatest(total("pb", n), F.lit(1))) for n in orders), F.lit(0.0))
        return F.when(F.least(*[clip[f"b{n}_clip"] for n in orders]) == 0, F.lit(0.0)).otherwise(bp * F.exp(logsum / BLEU_ORDER))

    def rouge_n(n):
        c = clip[f"r{n}_clip"]
        return f_measure(c / F.greatest(total("pr", n), F.lit(1)), c / F.greatest(total("rr", n), F.lit(1)))

    def rouge_l():
        lp, lr = length["pr"], length["rr"]
        return F.when((lp == 0) | (lr == 0), F.lit(0.0)).otherwise(f_measure(safe_div(clip["lcs"], lp), safe_div(clip["lcs"], lr)))

    made = {"bleu": bleu, "rouge1": lambda: rouge_n(1), "rouge2": lambda: rouge_n(2), "rougeL": rouge_l}
    out = {m: made[m]() for m in wanted}
    return out | ({"lcs": clip["lcs"].cast("bigint")} if "rougeL" in wanted else {})


def text_scores(pairs: DataFrame, key: list[str] | None = None, pred: str = "pred", ref: str = "ref",
                impl: str = "arrow", stem: bool = False, metrics: list[str] | None = None,
                tokens: Callable[[Column], Column] = bleu_tokens) -> DataFrame:
    """Per pair: the wanted ``metrics`` (default bleu, rouge1, rouge2, rougeL with the LCS length).

    impl: "arrow" (row-local UDF) or "native" (explode + groupBy, LCS by UDF; all metrics, unstemmed: the
    second derivation that tests compare).  stem: Porter-stem ROUGE tokens longer than 3 characters.  tokens: as in
    ``with_text_scores``.
    """
    key = key or PAIR_KEY
    plain = pairs.select(*key, F.col(pred).alias("pred"), F.col(ref).alias("ref"))
    if impl == "arrow" or stem:
        return with_text_scores(plain, F.col("pred"), F.col("ref"), stem, metrics, tokens).drop("pred", "ref")
    base = tokenize_pairs(plain.select(*key, py_strip(F.col("pred")).alias("pred"), py_strip(F.col("ref")).alias("ref")))
    j = overlap_features(base, key)
    sizes = {c: F.size(n).cast("bigint") for c, n in zip(LENGTHS, ("pred_bt", "ref_bt", "pred_rt", "ref_rt"))}
    scores = _score_columns(sizes, {c: F.col(c) for c in _FEATURES}, METRICS)
    return j.select(*key, *[c.alias(n) for n, c in scores.items()])


def text_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M9: mean of per-pair scores per cell, whatever order they come in; 0.0 for an empty cell."""
    by = by or CELL
    return scores.groupBy(*by).agg(
        *[safe_div(exact_sum(c), F.count(c)).alias(c) for c in ("bleu", "rouge1", "rouge2", "rougeL")],
        F.count(F.lit(1)).alias("n_pairs"),
    )


def stem_dictionary(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, stem of every distinct ROUGE token longer than 3 characters: the vocabulary is deduplicated first, so each word is stemmed
    once, by SQL expressions alone.  For joins and reports; the scores stem inside their own step, by the same rules."""
    words = texts.select(F.explode(F.array_distinct(rouge_tokens(F.col(column)))).alias("word")).where(F.length("word") > 3).distinct()
    return stem_words(words)

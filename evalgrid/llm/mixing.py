"""Operator 6: soft-membership mixing.  DataFrame functions only.

A multinomial naive Bayes classifier, fitted on a labelled table, gives every document posteriors over
domains.  A document's domain tokens are its tokens times its posteriors.  Rates (how often a document
is used) are the nonnegative least-squares fit of the expected domain totals to the targets, found by
projected gradient from rate 1: each step needs one distributed sum per domain, and a document's
rate is a function of its posteriors and the short list of past gradients, so no per-document state is
carried and a lost executor costs one sum.

Features: words hashed to ``FEATURES`` buckets, and the text's style: its shares of capitals, of other marks and of
different words, in steps.  Texts are scored per feature on average (``TEMPERATURE`` tokens' worth), as raw naive Bayes
is far too sure of long texts.

Defined cases: null and empty texts have no tokens, posteriors equal to the priors and rate 1, as no
rate of theirs changes a total; null ids and repeated rows are scored each; documents may have
any label or none; an empty label table gives one domain ``all``; an empty table gives no rows; targets
of domains that the labels don't know are refused.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import below, cut
from evalgrid.llm.quality import let, words_of

FEATURES = 8192
TEMPERATURE = 12.0
MAX_TRAIN = 20_000
STEPS = 24
STYLE = 2.0


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(FEATURES)).cast("int")


def _features(text: Column) -> Column:
    """``words``: bucket of each word; ``marks``: buckets of the text's style (shares of capitals, of marks and of
    different words, in steps)."""
    size = F.greatest(F.length(text), F.lit(1))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / size
    others = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")) / size
    def style(w):
        variety = F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))
        return F.array(*[_bucket(F.lit(f"\x01{name}"), F.floor(share * 12).cast("int"))
                         for name, share in (("capitals", capitals), ("others", others), ("variety", variety))])
    return let(words_of(text), lambda w: F.struct(F.transform(w, lambda x: _bucket(x)).alias("words"), style(w).alias("marks")))


def fit_classifier(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row: ``domains`` array<string>; ``priors`` array<double> and ``weights`` array<array<double>> (by feature) of all
    domains but the first, less those of the first.

    ``labelled``: doc_id, domain.  Fitted on a hash sample of about ``max_train`` labelled ids; the row is
    bounded by domains x FEATURES."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    if n > max_train:
        known = known.where(below(max_train / n, "doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # each feature counts once per document, so that one repetitive text is one vote
    counts = (rows.select("domain", F.explode(
        let(_features(F.coalesce("text", F.lit(""))), lambda f: F.concat(F.array_distinct(f["words"]), f["marks"]))).alias("f"))
              .groupBy("domain", "f").agg(F.count(F.lit(1)).alias("n")))
    weights = counts.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("f", "n"))).alias("by"), F.sum("n").alias("total"))
    sizes = known.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"))
    table = sizes.join(weights, "domain", "left").select(
        "domain", "docs", F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda f: F.log(
            (F.coalesce(F.try_element_at("by", f), F.lit(0)) + 0.5) / (F.coalesce("total", F.lit(0)) + 0.5 * FEATURES))).alias("w"))
    row = table.agg(F.sort_array(F.collect_list(F.struct("domain", "docs", "w"))).alias("t"))
    first, rest = F.get("t", F.lit(0)), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    return row.select(
        F.when(F.size("t") > 0, F.transform("t", lambda x: x["domain"])).otherwise(F.array(F.lit("all"))).alias("domains"),
        F.transform(rest, lambda x: F.log(x["docs"] / first["docs"])).alias("priors"),
        F.transform(rest, lambda x: F.zip_with(x["w"], first["w"], lambda a, b: a - b)).alias("weights"))


def posteriors(docs: DataFrame, classifier: DataFrame) -> DataFrame:
    """``docs`` with tokens long and posterior array<double> (in the order of the classifier's domains)."""
    # scalar subqueries: one row, domains x FEATURES numbers
    model = {c: classifier.select(c).scalar() for c in ("priors", "weights")}
    def total(w, buckets):
        return F.aggregate(buckets, F.lit(0.0), lambda a, k: a + F.get(w, k))
    def likelihood(f):
        scale = TEMPERATURE / F.greatest(F.size(f["words"]), F.lit(1))
        # priors and weights are relative to the first domain, whose own are 0
        return F.concat(F.array(F.lit(0.0)), F.zip_with(
            "priors", "weights", lambda p, w: p + scale * total(w, f["words"]) + STYLE * total(w, f["marks"])))
    def softmax(z):
        return let(F.transform(z, lambda x: F.exp(x - F.array_max(z))),
                   lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))
    scored = let(_features(F.coalesce("text", F.lit(""))), lambda f: F.struct(
        F.size(f["words"]).cast("long").alias("tokens"), let(likelihood(f), softmax).alias("posterior")))
    return (docs.withColumns(model).withColumn("_s", scored)
            .withColumns({"tokens": F.col("_s.tokens"), "posterior": F.col("_s.posterior")}).drop("priors", "weights", "_s"))


def _rate(posterior: Column, moves: list[list[float]], start: Column | float = 1.0) -> Column:
    """The rate after projected steps from ``start``: each moves along the posteriors, then back to zero or more."""
    steps = F.array(*[F.array(*map(F.lit, m)) for m in moves]) if moves else F.array().cast("array<array<double>>")
    return F.aggregate(steps, F.lit(start) if isinstance(start, float) else start, lambda r, m: F.greatest(
        F.lit(0.0), r - F.aggregate(F.zip_with(posterior, m, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)))


def fit_rates(scored: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = 1e-3) -> list[list[float]]:
    """Moves of the projected gradient.  ``scored``: tokens, posterior; read once per step, so give a stored table.

    Minimises f = sum_k ((expected_k - target_k)^2 / size_k) over rates >= 0.  One scan tries two steps: the gradient scaled by
    the inverse of the second derivatives over the rates above zero, taken if it lowers f by a tenth, and the plain one, which
    is safe (divided by the present domain sizes the largest eigenvalue is at most 1).  Ends when the totals are
    within ``tolerance`` (a share of all tokens), or after ``steps`` with a warning: no rates meet targets outside
    the cone of the posteriors, and the least-squares answer to these, a few documents used very often, is only neared."""
    k, wanted = len(targets), max(sum(targets), 1e-9)
    aim = np.array(targets, dtype=float)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def look(moves, tries):
        """(totals, second derivatives over the free rates) after ``moves`` and each one of ``tries``."""
        p, t = F.col("posterior"), F.col("tokens")
        names = [f"r{i}" for i in range(len(tries))]
        rows = scored.select("tokens", "posterior", _rate(p, moves).alias("r")).select(
            "tokens", "posterior", *[_rate(p, m, F.col("r")).alias(c) for m, c in zip(tries, names)])
        got = rows.agg(*[F.sum(t * F.col(c) * p[i]) for c in names for i in range(k)],
                       *[F.sum(F.when(F.col(c) > 0, t * p[i] * p[j])) for c in names for i, j in pairs]).first()
        got = np.array([float(x or 0.0) for x in got])
        second = got[k * len(tries):].reshape(len(tries), -1)
        return [(now, np.array([[flat[pairs.index((min(i, j), max(i, j)))] for j in range(k)] for i in range(k)]))
                for now, flat in zip(got[:k * len(tries)].reshape(-1, k), second)]

    def distance(now):
        return float(((now - aim) ** 2 / size).sum())

    now, second = look([], [[]])[0]
    size = np.maximum(now, 1.0)
    moves: list[list[float]] = []
    while len(moves) < steps and np.abs(now - aim).sum() / wanted > tolerance:
        tries = [np.linalg.lstsq(second, now - aim, rcond=1e-9)[0].tolist(), ((now - aim) / size).tolist()]
        after = look(moves, [tries[:1], tries[1:]])
        best = 0 if distance(after[0][0]) < 0.9 * distance(now) else 1
        moves.append(tries[best])
        now, second = after[best]
    off = np.abs(now - aim).sum() / wanted
    if off > tolerance:
        warnings.warn(f"rates leave the totals {off:.4f} of all tokens off their targets after {len(moves)} steps (tolerance {tolerance})",
                      stacklevel=2)
    return moves


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_tokens: float | None = None,
        keep: str | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` with tokens, posterior, rate double and copies int.

    ``weights``: share of tokens wanted per domain; domains left out get 0.  ``total_tokens``: wanted in all
    (default: as many as there are, or with ``keep`` so many that this domain keeps its expected tokens).
    ``copies``: the rate rounded up or down by a hash of (doc_id, text), with the rate as its mean and the same in
    every run, so what is used meets the targets as the rates do."""
    classifier = cut(fit_classifier(docs, labelled, max_train), "mix-model")
    domains = classifier.select("domains").first()[0]
    if domains != ["all"] and set(weights) - set(domains):
        raise ValueError(f"no labelled rows of {sorted(set(weights) - set(domains))}")
    scored = cut(posteriors(docs, classifier), "mix-posteriors")
    share = [weights.get(d, 0.0) for d in domains] if domains != ["all"] else [1.0]
    if min(share) < 0 or not math.isfinite(sum(share)) or sum(share) <= 0:
        raise ValueError("weights must be nonnegative, finite and not all zero")
    share = [s / sum(share) for s in share]
    if total_tokens is None:
        at = domains.index(keep) if keep in domains else None
        weight = F.col("tokens") * (F.col("posterior")[at] if at is not None else 1.0)
        total_tokens = float(scored.agg(F.sum(weight)).first()[0] or 0) / (share[at] if at is not None else 1.0)
    moves = fit_rates(scored, [s * total_tokens for s in share])
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("tokens") > 0, _rate(F.col("posterior"), moves)).otherwise(1.0)
    return scored.withColumn("rate", rate).withColumn(
        "copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))

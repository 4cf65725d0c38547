"""Operator 12: hard negatives by exact integer inner products.

Rows are packed into blocks of at most BLOCK vectors of one length and anchors into smaller ones; every anchor block meets every
block of rows once.  The scores of two blocks are exact integers from float32 matrix products: the components are taken modulo several
small primes, chosen so that a product of residues cannot pass 2^24 and is exact in float32, the products
are multiplied matrix by matrix, and the signed scores come back by Chinese remaindering.  The number of primes follows
from the largest components of the two blocks.

Selection is by windows twice.  First each anchor's best rows of its own label, at most ``positives`` of each block and then of
all.  Then, for each anchor and positive, the best rows of other labels whose score lies between ``low`` and ``high`` percent of
the positive's, at most ``negatives`` of each block and then of all.  No pair of rows leaves a task otherwise.

Defined cases: rows with a null label, vector or id, or with a null or non-finite component, take no part; an anchor only
meets vectors of its own length; repeated rows count once, and an id with several rows counts with the smallest (label, vector);
ties go to the smaller id; an anchor without positives, or a positive without negatives, gives no rows; an empty table gives
none; extra columns are ignored.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.llm.common import cut

SCALE = 256
BLOCK = 16_384
ANCHORS = 1024
# Anchors whose scores with a block are held at once, and components of one exact float32 product.
ROWS_AT_ONCE, DEPTH = 128, 1024
EXACT = 1 << 24


def residue_primes(depth: int, bound: int) -> list[int]:
    """Primes whose symmetric residues keep a sum of ``depth`` products below 2^24, largest first, until they tell apart all
    integers from -bound to bound."""
    top = 2 * math.isqrt((EXACT - 1) // max(depth, 1)) + 1
    sieve = np.ones(top + 1, bool)
    for n in range(2, math.isqrt(top) + 1):
        sieve[n * n::n] = False
    chosen, product = [], 1
    for p in np.flatnonzero(sieve)[:1:-1].tolist():
        if product > 2 * bound:
            return chosen
        chosen.append(p)
        product *= p
    if product > 2 * bound:
        return chosen
    raise ValueError(f"scores of up to {bound} are beyond the primes below {top}")


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    half = p // 2
    return (np.mod(x + half, p) - half).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer-valued float64 matrices: int64, or Python integers where 64 bits could not hold
    what remaindering needs."""
    bound = max(1, a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)))
    primes = residue_primes(min(a.shape[1], DEPTH), bound)
    kind = np.int64 if math.prod(primes) < 1 << 62 else object
    total, product = None, 1
    for p in primes:
        left, right = _residues(a, p), _residues(b, p)
        r = np.zeros((len(a), len(b)), dtype=np.int64)
        for at in range(0, a.shape[1], DEPTH):
            r += (left[:, at:at + DEPTH] @ right[:, at:at + DEPTH].T).astype(np.int64)
        r = (r % p).astype(kind)
        if total is None:
            total = r
        else:  # the next digit in mixed radix
            total = total + product * ((r - total) % p * pow(product, -1, p) % p)
        product *= p
    return np.where(total > product // 2, total - product, total)


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id, label, vec, pos) of one vector length, ordered by id: dim, kind, ids, labels, comps, pos (an
    array for each row), as bytes where they are numbers."""
    kind = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()),
                      ("comps", pa.binary()), ("pos", pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))])

    def block(number, dim, parts):
        ids, labels, comps = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(ids, kind="stable")
        comps = comps[order]
        largest = np.abs(comps).max(initial=0)
        narrow = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.float64
        pos = [x for p in parts for x in p[3]]
        return pa.RecordBatch.from_pydict({
            "block": [number], "dim": [dim], "kind": [np.dtype(narrow).str], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()],
            "comps": [comps.astype(narrow).tobytes()], "pos": [[pos[i] for i in order]]}, schema=kind)

    def run(batches):
        held: dict[int, list] = {}
        made, part = 0, 0
        for batch in batches:
            part = batch.column(4)[0].as_py() if batch.num_rows else part
            dims = pc.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                for at in range(0, mine.num_rows, size):
                    rows = mine.slice(at, size)
                    parts = held.setdefault(dim, [])
                    if sum(len(p[0]) for p in parts) + rows.num_rows > size:
                        yield block((part << 32) + made, dim, parts)
                        made += 1
                        parts.clear()
                    comps = np.floor(SCALE * rows.column(2).flatten().to_numpy().astype(np.float64)).reshape(rows.num_rows, dim)
                    parts.append((rows.column(0).to_numpy(), rows.column(1).to_numpy(), comps, rows.column(3).to_pylist()))
        for dim, parts in held.items():
            if parts:
                yield block((part << 32) + made, dim, parts)
                made += 1

    return rows.select("id", "label", "vec", "pos", F.spark_partition_id().cast("long")).mapInArrow(
        run, "block long, dim int, kind string, ids binary, labels binary, comps binary, pos array<array<struct<id:long,score:long>>>")


def _meet(blocks: DataFrame, n_blocks: int, anchors: DataFrame) -> DataFrame:
    """Every anchor block beside every block of rows of its vector length: anchors are dealt to as many slices as there are blocks."""
    there = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(n_blocks)))
    here = anchors.select("dim", *[F.col(c).alias("a_" + c) for c in ("kind", "ids", "labels", "comps", "pos")],
                          F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("slice"))
    return there.join(here, ["dim", "slice"]).select("dim", "kind", "ids", "labels", "comps", "a_kind", "a_ids", "a_labels", "a_comps", "a_pos")


def _pairs(batches) -> Iterator[tuple]:
    """For some anchors and a block: the anchors' ids, labels and positives, the block's ids and labels, and the scores."""
    for batch in batches:
        for x in batch.to_pylist():
            def matrix(prefix, dim=x["dim"], x=x):
                ids = np.frombuffer(x[prefix + "ids"], np.int64)
                comps = np.frombuffer(x[prefix + "comps"], np.dtype(x[prefix + "kind"])).astype(np.float64).reshape(len(ids), dim)
                return ids, np.frombuffer(x[prefix + "labels"], np.int64), comps
            ids, labels, comps = matrix("")
            a_ids, a_labels, a_comps = matrix("a_")
            for at in range(0, len(a_ids), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                yield a_ids[some], a_labels[some], x["a_pos"][some], ids, labels, exact_scores(a_comps[some], comps)


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest, highest first, earlier ones first among equals."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.argsort(-scores[near], kind="stable")[:n]]
    return np.argsort(-scores, kind="stable")[:n]


def _best_rows(pairs: DataFrame, n: int) -> DataFrame:
    """anchor, id, score: at most ``n`` rows of the anchor's label from each block."""
    def run(batches):
        for a_ids, a_labels, _, ids, labels, scores in _pairs(batches):
            out: list[tuple] = []
            for anchor, label, row in zip(a_ids.tolist(), a_labels, scores):
                same = np.flatnonzero((labels == label) & (ids != anchor))
                best = same[_first(row[same], n)]
                out += zip([anchor] * len(best), ids[best].tolist(), row[best].tolist())
            yield pa.RecordBatch.from_pydict(dict(zip(("anchor", "id", "score"), zip(*out) if out else ((), (), ()))), schema=pa.schema(
                [("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    return pairs.mapInArrow(run, "anchor long, id long, score long")


def _in_window(pairs: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """anchor, positive, positive_score, id, score: at most ``n`` rows of other labels from each block for each positive."""
    names = ("anchor", "positive", "positive_score", "id", "score")

    def run(batches):
        for a_ids, a_labels, a_pos, ids, labels, scores in _pairs(batches):
            out: list[tuple] = []
            for anchor, label, positives, row in zip(a_ids.tolist(), a_labels, a_pos, scores):
                # low * p <= 100 * s <= high * p, as bounds of s in whole numbers
                bounds = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                most, least = max(h for _, h in bounds), min(m for m, _ in bounds)
                other = np.flatnonzero((labels != label) & (row <= most) & (row >= least))
                for p, (down, up) in zip(positives, bounds):
                    mine = other[(row[other] <= up) & (row[other] >= down)]
                    best = mine[_first(row[mine], n)]
                    out += zip([anchor] * len(best), [p["id"]] * len(best), [p["score"]] * len(best), ids[best].tolist(), row[best].tolist())
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else ((),) * 5)), schema=pa.schema([(c, pa.int64()) for c in names]))

    return pairs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def valid_rows(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, vec (array<double>) of the rows that take part, one for each id."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and label is not null and vec is not null").where(finite))
    # ids alone are counted; vectors are only grouped for ids that come again
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if not twice.take(1):
        return rows
    settled = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    return rows.join(twice, "id", "left_anti").unionByName(settled)


def hard_negatives(rows: DataFrame, anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``rows``: id, label, vec (``valid_rows``).  ``anchor``: which rows are anchors.  One row for each negative: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score."""
    none = F.array().cast("array<struct<id:long,score:long>>")
    blocks = cut(_pack(rows.withColumn("pos", none), BLOCK), "negatives-blocks")
    chosen = cut(rows.where(anchor), "negatives-anchors")
    n_blocks, n_anchors = max(1, blocks.count()), chosen.count()
    tasks = max(1, math.ceil(n_anchors / ANCHORS))

    def best(df, by, n, order):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    order = [F.desc("score"), "id"]
    found = _best_rows(_meet(blocks, n_blocks, _pack(chosen.withColumn("pos", none).repartition(tasks), ANCHORS)), positives)
    kept = best(found, ["anchor"], positives, order).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    kept = kept.select(F.col("anchor").alias("id"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("pos"))
    with_pos = cut(chosen.join(kept, "id"), "negatives-positives")
    found = _in_window(_meet(blocks, n_blocks, _pack(with_pos.repartition(tasks), ANCHORS)), negatives, low, high)
    return best(found, ["anchor", "positive"], negatives, order).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

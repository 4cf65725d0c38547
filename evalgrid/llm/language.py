"""Operator 4: language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z) and split into words at ASCII white space; it ends with an end token.  It is coded as
running text: each word as its bytes and a space, the end as one line feed.  Each byte is eight binary decisions, and
each decision's contexts are the last 0 to ``DEPTH`` bytes before it, across spaces, back to the text's start (which
counts as a space).  Every context counts its zeros and ones and estimates them by Krichevsky-Trofimov;
context-tree weighting mixes, at every context, its own estimate with its longer contexts', weighted by how
well each has coded the training texts.

1. words are counted for the base score (all words, training counts; one distributed aggregate),
2. the tree's counts come from all texts as (context, byte) rows, added up in each task before they are shuffled,
3. the tree is weighted bottom-up and read top-down per two-byte context, its trunk (at most 256 x 255
   decisions of context length 0 and 1) on the driver,
4. every text sums the code lengths of its bytes: from a broadcast table of (context, byte) rows, or where that is
   too large from the rows that its slice of the texts needs, found by a join.

Base scores are summed in two parts: the most frequent words (at most ``FREQUENT``, by a count threshold)
from a broadcast table, all others by a join with the table of all words.

Defined cases: null and empty texts are the end token alone; rows with a null id are held out; repeated rows
count and are scored each; without training rows every decision has probability 1/2 and base scores use
N = V = 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import cut, id_fold

DEPTH = 5
FREQUENT = 1 << 18
MAX_BROADCAST_GRAMS = 6_000_000
END = b"\n"
_FLUSH = 200_000
_CHUNK = 4_000_000  # bytes of text whose grams are counted at once
_RUN = 300_000  # bytes of text whose grams are looked up at once
_HELD = 4_000_000  # grams that a task adds up before it hands them on
SLICE = 32_000_000  # bytes of text whose grams are looked up by one group of the join


def tokens_of(text: str | None) -> list[bytes]:
    """Words by ASCII white space, A-Z lowered, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def count_words(docs: DataFrame) -> DataFrame:
    """token binary, train long, every long.  ``docs``: text, train (boolean)."""
    kind = pa.schema([("token", pa.binary()), ("train", pa.int64()), ("every", pa.int64())])

    def run(batches):
        train, every = Counter(), Counter()

        def flush():
            keys = list(every)
            out = pa.RecordBatch.from_pydict({"token": keys, "train": [train[k] for k in keys], "every": [every[k] for k in keys]}, schema=kind)
            train.clear()
            every.clear()
            return out
        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                words = tokens_of(text.as_py())
                every.update(words)
                if learn:
                    train.update(words)
                if len(every) > _FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select("text", "train").mapInArrow(run, "token binary, train long, every long")
    return counted.groupBy("token").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def grams_of(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): for each coded byte of each word the key context * 256 + byte, and where each word's keys start.

    A word that ends in ``END`` is a whole text: its words, each with a space behind it, and the end."""
    pad = b"\0" * (depth - 1) + b" "
    coded = [w if w.endswith(END) else w + b" " for w in words]
    data = np.frombuffer(pad + pad.join(coded) if words else b"", dtype=np.uint8)
    sizes = np.array([len(w) for w in coded], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(words) else np.zeros(0, np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(words)) + 1) * depth, sizes)
    keys = np.zeros(len(at), dtype=np.int64)
    for back in range(depth, -1, -1):
        keys <<= 8
        keys |= data[at - back]
    return keys, starts


def coded_text(tokens: list[bytes]) -> bytes:
    """The running text of ``tokens_of``'s tokens: a space behind each word, then the end."""
    return b" ".join(tokens)


def chunks(texts: list[bytes], size: int | None = None):
    """Runs of texts of about ``size`` bytes."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= (size or _RUN):
            yield run
            run, held = [], 0
    if run:
        yield run


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _gram_batches(keys: np.ndarray, n: np.ndarray):
    for i in range(0, len(keys), _FLUSH):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + _FLUSH]), pa.array(n[i:i + _FLUSH])], names=["key", "n"])


def count_grams(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key long, n long: training count of each (context, byte) of any word, also of words that training lacks (0)."""
    def run(batches):
        for batch in batches:
            keys, starts = grams_of(batch.column(0).to_pylist(), depth)
            sizes = np.diff(np.append(starts, len(keys)))
            yield from _gram_batches(*_added(keys, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)))

    return words.select("token", "train").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_text_grams(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key long, n long: training count of each (context, byte) of the running texts, also of those that training lacks (0).
    ``docs``: text, train (boolean)."""
    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def add(learn):
            nonlocal held
            keys = grams_of(waiting[learn], depth)[0]
            keys.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys))) * learn
            held = _added(np.concatenate((held[0], keys[first])), np.concatenate((held[1], n)))
            waiting[learn], sizes[learn] = [], 0
        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                coded = coded_text(tokens_of(text.as_py()))
                waiting[learn].append(coded)
                sizes[learn] += len(coded)
                if sizes[learn] >= _CHUNK:
                    add(learn)
                    if len(held[0]) > _HELD:
                        yield from _gram_batches(*held)
                        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        add(True)
        add(False)
        yield from _gram_batches(*held)

    return docs.select("text", "train").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = 1 << 12
_HALF, _ONE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _log_gamma_of(counts: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """``log_gamma(counts + shift)`` of whole counts, small ones from a table."""
    out = table[np.minimum(counts, _SMALL - 1).astype(np.int64)]
    large = counts >= _SMALL
    if large.any():
        out[large] = log_gamma(counts[large] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return _log_gamma_of(a, _HALF, 0.5) + _log_gamma_of(b, _HALF, 0.5) - _log_gamma_of(a + b, _ONE, 1.0) - math.log(math.pi)


class Level:
    """The decisions of one context length: node ids (context * 256 + bits so far behind a leading 1), counts, weights.

    ``grams``: the distinct (context, byte) keys in order, so that keys of one node stand together; ``places`` has the nodes
    of each as 8 x n, ``first`` a key of each node, ``bit`` which of the eight decisions it is."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        places, first = [], []
        for i in range(8):
            node = grams >> (8 - i)
            new = np.concatenate((np.ones(min(1, len(grams)), bool), node[1:] != node[:-1]))
            places.append(np.cumsum(new) - 1 + sum(map(len, first)))
            first.append(np.flatnonzero(new))
        self.places, self.bit, self.first = np.array(places), np.repeat(np.arange(8), [len(x) for x in first]), np.concatenate(first)
        prefix, bits = decisions(grams)
        self.ids = grams[self.first] >> 8 << 8 | prefix[self.bit, self.first]
        self.ones = np.bincount(self.places.ravel(), (n * bits).ravel(), len(self.ids))
        self.all = np.bincount(self.places.ravel(), np.broadcast_to(n, bits.shape).ravel(), len(self.ids))
        self.log_kt = log_kt(self.all - self.ones, self.ones)
        self.kt = (self.ones + 0.5) / (self.all + 1)  # of a one
        self.log_w, self.own = self.log_kt, np.ones(len(self.ids))
        self.of = self.places  # nodes of each key of the tree

    def mix(self, longer: np.ndarray) -> None:
        """Weight with the summed log weights of the longer contexts."""
        self.log_w = np.logaddexp(self.log_kt, longer) + math.log(0.5)
        self.own = np.exp(math.log(0.5) + self.log_kt - self.log_w)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits so far behind a leading 1, next bit) of the eight decisions of each key's byte, as 8 x n."""
    byte = keys & 255
    i = np.arange(8)[:, None]
    return 1 << i | byte >> (8 - i), byte >> (7 - i) & 1


def tree(keys: np.ndarray, n: np.ndarray, depth: int, trunk: int) -> list[Level]:
    """Levels trunk .. depth of the (sub)tree of these grams, weighted bottom-up.  ``depth``: at most 6 (keys have 63 bits)."""
    grams, at = np.unique(keys, return_inverse=True)
    levels = [Level(grams, np.bincount(at, n, len(grams)))]
    levels[0].of = levels[0].places[:, at]
    for d in range(depth - 1, trunk - 1, -1):
        low = levels[0]
        grams, back = np.unique(low.grams & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        up = Level(grams, np.bincount(back, low.n, len(grams)))
        at = back[at]
        up.of = up.places[:, at]
        up.mix(np.bincount(up.places[low.bit, back[low.first]], low.log_w, len(up.ids)))
        levels.insert(0, up)
    return levels


def read_down(levels: list[Level], p: np.ndarray | None = None) -> np.ndarray:
    """Probability of a one at each decision, mixed from the longest context that was seen to the first level."""
    for level in reversed(levels):
        kt, own, seen = level.kt[level.of], level.own[level.of], level.all[level.of] > 0
        p = np.full(kt.shape, np.nan) if p is None else p
        p = np.where(seen, np.where(np.isnan(p), kt, own * kt + (1 - own) * p), p)
    return p


class Trunk:
    """Contexts of length 0 and 1 of the whole tree: at most 256 x 255 decisions."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        ids, log_w, ones, total = (np.array(x, dtype=t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (np.int64, float, float, float)))
        self.tables = []
        level, longer = ids, log_w
        for d in (1, 0):
            node = level & 255 if d == 0 else level
            at, inverse = np.unique(node, return_inverse=True)
            sums = [np.bincount(inverse, x, len(at)) for x in (longer, ones, total)]
            kt_log = log_kt(sums[2] - sums[1], sums[1])
            log_w = np.logaddexp(kt_log, sums[0]) + math.log(0.5)
            kt, own, seen = np.full(1 << 16, 0.5), np.ones(1 << 16), np.zeros(1 << 16, bool)
            kt[at], own[at], seen[at] = (sums[1] + 0.5) / (sums[2] + 1), np.exp(math.log(0.5) + kt_log - log_w), sums[2] > 0
            self.tables.append((kt, own, seen))
            level, longer, ones, total = at, log_w, sums[1], sums[2]

    def mix(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        prefix, _ = decisions(keys)
        for d, (kt, own, seen) in zip((1, 0), self.tables):
            at = (keys >> 8 & 255) << 8 | prefix if d else prefix
            p = np.where(seen[at], np.where(np.isnan(p), kt[at], own[at] * kt[at] + (1 - own[at]) * p), p)
        return np.where(np.isnan(p), 0.5, p)


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, lp: log10 probability of the byte in its context under the weighted tree.  ``grams``: a stored table."""
    trunk_depth = 2
    # one group is the subtree of a two-byte context: its longer contexts and their bytes
    grouped = grams.withColumn("sub", F.shiftright("key", 8).bitwiseAND((1 << 8 * trunk_depth) - 1))

    def up(batch: pa.Table) -> pa.Table:
        root = tree(batch["key"].to_numpy(), batch["n"].to_numpy(), depth, trunk_depth)[0]
        parent = (root.ids >> 8 & 255) << 8 | root.ids & 255
        return pa.table({"id": parent, "log_w": root.log_w, "ones": root.ones, "total": root.all})

    rows = grouped.groupBy("sub").applyInArrow(up, "id long, log_w double, ones double, total double").groupBy("id").agg(
        F.sum("log_w"), F.sum("ones"), F.sum("total")).collect()
    trunk = Trunk([tuple(r) for r in rows])

    def down(batch: pa.Table) -> pa.Table:
        keys = batch["key"].to_numpy()
        p = trunk.mix(keys, read_down(tree(keys, batch["n"].to_numpy(), depth, trunk_depth)))
        bits = decisions(keys)[1]
        return pa.table({"key": keys, "lp": np.log10(np.where(bits == 1, p, 1 - p)).sum(axis=0)})

    return grouped.groupBy("sub").applyInArrow(down, "key long, lp double")


def sums_of(texts: list[bytes], known: np.ndarray, lp: np.ndarray, depth: int) -> np.ndarray:
    """The summed ``lp`` of each text's keys; ``known`` has them all, in order."""
    out = [np.zeros(0)]
    for run in chunks(texts):
        keys, starts = grams_of(run, depth)
        distinct, back = np.unique(keys, return_inverse=True)
        out.append(np.add.reduceat(lp[np.searchsorted(known, distinct)][back], starts))
    return np.concatenate(out)


def _model(scores: DataFrame):
    """(keys in order, their lp) as a broadcast."""
    table = scores.orderBy("key").toArrow()
    return scores.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["lp"].to_numpy()))


def word_scores(words: DataFrame, scores: DataFrame, depth: int = DEPTH, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """``words`` with lp: the log10 probability of each word.  The (context, byte) table is broadcast up to
    ``max_broadcast`` rows (16 bytes each), and joined beyond that."""
    if scores.count() <= max_broadcast:
        model = _model(scores)

        def run(batches):
            for batch in batches:
                total = sums_of(batch.column(0).to_pylist(), *model.value, depth)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=["token", "train", "lp"])
        return words.select("token", "train").mapInArrow(run, "token binary, train long, lp double")

    def expand(batches):
        for batch in batches:
            keys, starts = grams_of(batch.column(0).to_pylist(), depth)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(keys))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(keys)],
                                             names=["token", "train", "key"])
    spread = words.select("token", "train").mapInArrow(expand, "token binary, train long, key long")
    return spread.join(scores, "key").groupBy("token", "train").agg(F.sum("lp").alias("lp"))


def slice_scores(texts: DataFrame, scores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row, lp: the log10 probability of each running text by a join.  ``texts``: row, slice (a bounded group of rows), coded; stored.
    A slice asks for each of its keys once, so what is shuffled doesn't repeat a key for every byte."""
    def ask(batch: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] + [np.unique(grams_of(run, depth)[0]) for run in chunks(batch["coded"].to_pylist())]
        keys = np.unique(np.concatenate(found))
        return pa.table({"slice": np.full(len(keys), batch["slice"][0].as_py(), dtype=np.int64), "key": keys})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["key"].to_numpy())
        known, lp = right["key"].to_numpy()[order], right["lp"].to_numpy()[order]
        return pa.table({"row": left["row"], "lp": sums_of(left["coded"].to_pylist(), known, lp, depth)})

    asked = texts.select("slice", "coded").groupBy("slice").applyInArrow(ask, "slice long, key long").join(scores, "key")
    return texts.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(answer, "row long, lp double")


def score_documents(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, max_broadcast: int = MAX_BROADCAST_GRAMS,
                    holdout_mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "train", id_fold("doc_id", holdout_mod) != 0)
    table = cut(count_words(rows), "lm-words")
    n, v = table.where("train > 0").agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.lit(1))).first()
    grams = cut(count_text_grams(rows, depth), "lm-grams")
    scores = cut(gram_scores(grams, depth), "lm-scores")
    model = _model(scores) if scores.count() <= max_broadcast else None

    # words of at least 2^floor training occurrences are the frequent ones: the lowest floor that admits few enough
    sizes = dict(table.where("train > 0").groupBy(F.floor(F.log2("train")).cast("int")).count().collect())
    floor, held = 64, 0
    while floor > 0 and held + sizes.get(floor - 1, 0) <= frequent:
        floor -= 1
        held += sizes.get(floor, 0)
    often = table.where(F.col("train") >= F.lit(float(2**floor))).select("token", "train").toArrow()
    total = n + 0.1 * (v + 1)
    base = np.log10((often["train"].to_numpy() + 0.1) / total)
    common = docs.sparkSession.sparkContext.broadcast(dict(zip(often["token"].to_pylist(), base.tolist())))
    pair = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))

    def run(batches):
        table = common.value
        slice_id, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_known", "base_score", "rare", "slice", "coded")}
            for text in batch.column(1):
                tokens = tokens_of(text.as_py())
                known, b, rare = 0, 0.0, []
                for token, k in Counter(tokens).items():
                    hit = table.get(token)
                    if hit is None:
                        rare.append((token, k))
                    else:
                        known += k
                        b += k * hit
                for name, value in zip(out, (len(tokens), known, b, [{"token": t, "n": k} for t, k in rare], slice_id, coded_text(tokens))):
                    out[name].append(value)
                filled += len(out["coded"][-1])
                if filled >= SLICE:
                    slice_id, filled = slice_id + 1, 0
            score = [None] * batch.num_rows
            if model is not None:
                score, out["coded"] = sums_of(out["coded"], *model.value, depth), [None] * batch.num_rows
            types = (pa.int64(), pa.int64(), pa.float64(), pair, pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(out[k], t) for k, t in zip(out, types)], pa.array(score, pa.float64())],
                                             names=["doc_id", "train", *out, "score"])

    part = cut(rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, rare array<struct<token:binary,n:int>>, "
                                    "slice long, coded binary, score double").withColumn("row", F.monotonically_increasing_id()), "lm-part")
    rest = (part.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n").join(table, "token")
            .groupBy("row").agg(F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("known"),
                                F.sum(F.col("n") * F.log10((F.col("train") + 0.1) / F.lit(total))).alias("base")))
    joined = part.drop("rare", "coded").join(rest, "row", "left")
    if model is None:
        joined = joined.drop("score").join(slice_scores(part.select("row", "slice", "coded"), scores, depth).withColumnRenamed("lp", "score"), "row")
    return joined.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score")

"""Operator 13: spelling variants by a dictionary of trie-node pairs.

Words are counted over all texts.  Two tries, of the words and of the reversed words, have their nodes numbered: a word then is
a path of numbers in each, and its text before and after any position is a pair (prefix node, suffix node).  A word
enters the dictionary with the pair around each of its letters (skipped) and with the pair at each place between letters
(inserted).  Words that skip to one pair differ in that letter; a word that skips to the pair at which another is split has
that one letter more.  Equal pairs thus are exactly the near words, with no text compared.

No pair has a large group: a pair and a letter make the word, so a group holds at most one skipping word for each letter of the alphabet and
one split word.  The near words of a group are counted and the best of them chosen inside it; no list of all pairs is made.

A trie is numbered by a scan of the sorted words, dealt by ranges: a word adds the nodes below its common prefix with the word before.  Nodes
that ranges share lie on the path of a range's last word, so the last words (one for each range) tell every task which nodes began
earlier and how they are numbered.

Defined cases: a null or empty text has no words; with a null doc_id no letter is deleted; a repeated row counts again; an empty table gives
no rows; extra columns are ignored; words may have any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import cut

MIN_LENGTH, MIN_COUNT = 5, 3
DELETE_EVERY = 97
WORDS_PER_TASK = 200_000
# Distinct words a task holds before it hands on their counts.
HELD = 400_000
LETTERS = "a-zÀ-ÿ"


def text_words(docs: DataFrame, min_length: int = MIN_LENGTH, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, n: partial counts of the words of all texts, A-Z in lower case, with a letter taken out of every
    ``delete_every``-th (document, word) by a hash."""
    find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=kind)

    def run(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = (text.as_py() or "").encode().lower().decode()  # of bytes, only A-Z have a lower case
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(find(lowered)).items():
                    if start is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= HELD:
                    yield out(total)
                    total = {}
        yield out(total)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, **options) -> DataFrame:
    """word, n of the words that occur at least ``min_count`` times; stored."""
    return cut(text_words(docs, **options).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "variants-words")


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def number_trie(words: DataFrame, tasks: int) -> DataFrame:
    """key, nodes, leads, place of each distinct ``key`` of ``words``: the numbers of the nodes of all its prefixes, from the empty one to the
    whole; for each letter, whether it differs from the one before it; and a number that follows the order of the keys."""
    placed = cut(words.select("key").repartitionByRange(tasks, "key").withColumn("part", F.spark_partition_id()), "variants-sorted")
    # one word for each range
    lasts = {r.part: r.last for r in placed.groupBy("part").agg(F.max("key").alias("last")).collect()}
    parts = sorted(lasts)
    began: dict[int, list[int]] = {}  # by range: for each depth of its last word's path, the range where that node began
    for i, part in enumerate(parts):
        same = _shared(lasts[parts[i - 1]], lasts[part]) + 1 if i else 0
        began[part] = (began[parts[i - 1]][:same] if i else []) + [part] * (len(lasts[part]) + 1 - same)
    earlier = dict(zip(parts[1:], parts))
    kind = pa.schema([("key", pa.string()), ("nodes", pa.list_(pa.int64())), ("leads", pa.list_(pa.bool_())), ("place", pa.int64())])

    def run(batches):
        now, path, last, n_nodes, n_words = None, [], "", 0, 0
        for batch in batches:
            keys, nodes, leads, places = [], [], [], []
            for part, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    now, path, last, n_nodes, n_words = part, [], "", 0, 0
                path = path[:_shared(last, key) + 1]
                # depths on the path of this range's last word, or of the last word of the range before
                own = _shared(key, lasts[part])
                old = _shared(key, lasts[earlier[part]]) if part in earlier else -1
                for depth in range(len(path), len(key) + 1):
                    if depth <= own:
                        path.append(began[part][depth] << 34 | 1 << 33 | depth)
                    elif depth <= old:
                        path.append(began[earlier[part]][depth] << 34 | 1 << 33 | depth)
                    else:
                        path.append(part << 34 | n_nodes)
                        n_nodes += 1
                last = key
                keys.append(key)
                nodes.append(path)
                leads.append([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
                places.append(part << 34 | n_words)
                n_words += 1
            yield pa.RecordBatch.from_pydict({"key": keys, "nodes": nodes, "leads": leads, "place": places}, schema=kind)

    dealt = placed.select("part", "key").repartition(tasks, "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(run, "key string, nodes array<long>, leads array<boolean>, place long")


def pair_dictionary(words: DataFrame, tasks: int) -> DataFrame:
    """word, n, place and entries of each word: (p, s, skip, lead), the pairs of nodes around each letter and between letters.  ``lead``: the
    letter differs from the one before; of a run of equal letters only the first counts as the one more."""
    ahead = number_trie(words.select(F.col("word").alias("key")), tasks).select(F.col("key").alias("word"), F.col("nodes").alias("ps"), "leads", "place")
    back = number_trie(words.select(F.reverse("word").alias("key")), tasks).select(F.reverse("key").alias("word"), F.col("nodes").alias("ss"))
    both = words.join(ahead, "word").join(back, "word").withColumn("size", F.size("leads"))
    skips = F.transform("leads", lambda lead, i: F.struct(
        F.get("ps", i).alias("p"), F.get("ss", F.col("size") - 1 - i).alias("s"), F.lit(True).alias("skip"), lead.alias("lead")))
    splits = F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.get("ss", F.col("size") - i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("lead")))
    return both.select("word", "n", "place", F.concat(skips, splits).alias("entries"))


def near_words(pairs: DataFrame) -> DataFrame:
    """place, n_near, best (n, place) of each word that has a near word: the near word of largest n, of equal ones the first in order."""
    rows = pairs.select("place", "n", F.explode("entries").alias("e")).select("e.p", "e.s", F.struct("e.skip", "e.lead", "n", "place").alias("x"))
    groups = rows.groupBy("p", "s").agg(F.collect_list("x").alias("g")).where((F.size("g") > 1) & F.exists("g", lambda x: x["skip"]))

    def near(x, y):
        return (x["place"] != y["place"]) & F.when(x["skip"] & y["skip"], True).when(x["skip"], x["lead"]).otherwise(y["skip"] & y["lead"])

    members = F.transform("g", lambda x: F.struct(x["place"].alias("place"), F.transform(
        F.filter("g", lambda y: near(x, y)), lambda y: F.struct(y["n"].alias("n"), (-y["place"]).alias("minus"))).alias("near")))
    found = groups.select(F.explode(members).alias("m")).select("m.place", F.size("m.near").alias("n_near"), F.array_max("m.near").alias("best"))
    merged = found.groupBy("place").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).where("n_near > 0")
    return merged.select("place", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.minus")).alias("place")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(place, root) from (place, form): each word's form, its form's form and so on to the last.  Steps double; n doubles with each form,
    so chains are short."""
    now = cut(forms.select("place", F.col("form").alias("root")), "variants-roots")
    while True:
        then = now.select(F.col("place").alias("root"), F.col("root").alias("far"))
        now = cut(now.join(then, "root", "left").select("place", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "variants-roots")
        if not now.where("moved").take(1):
            return now.select("place", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a stored table (word, n): see the contract in the module's docstring."""
    tasks = max(1, math.ceil(words.count() / WORDS_PER_TASK))
    pairs = cut(pair_dictionary(words, tasks), "variants-pairs")
    known = pairs.select("place", "word", "n").join(near_words(pairs), "place", "left")
    known = cut(known.withColumn("form", F.when(F.col("best.n") >= 2 * F.col("n"), F.col("best.place"))), "variants-near")
    roots = last_forms(known.where("form is not null").select("place", "form"))
    names = known.select(F.col("place").alias("to"), F.col("word").alias("name"))
    linked = known.where("form is not null").join(roots, "place")
    linked = (linked.join(names.select(F.col("to").alias("form"), F.col("name").alias("form_word")), "form")
              .join(names.select(F.col("to").alias("root"), F.col("name").alias("root_word")), "root"))
    near = F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    return linked.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", near, F.col("best.n").alias("form_n")).unionByName(
        known.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", near,
                                           F.lit(None).cast("long").alias("form_n")))

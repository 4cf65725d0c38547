"""Operator 2: line deduplication by a deletion-neighbourhood join (edit bound 1).

A line is removed when it occurred before, or when an earlier line is within one edit (insertion,
deletion or substitution of a character); of equal lines the earliest stays.  Order is (doc_id, text
fingerprint, line number).  "Earlier" looks at all lines of the input, also those removed themselves.

Variants of every line within the bound would be as many as the corpus has characters, so they are
emitted only where they can matter, and no pair is lost by that.  A line of length L can be the
shorter (n = L) or the longer (n = L - 1) of a pair; the edit then lies in one of the segments into
which n alone cuts a line, and both lines agree before and after that segment.  Lines that share this
outside with another line keep the segment (first for two halves, then for sixteen segments), and
deletion variants are made for the kept segments alone.  Two lines one substitution apart share the
variant and its place; a line that is another one plus a character has that line as its variant.
Groups of equal variants are aggregated to their earliest member, never paired; the pair of a line and
its earliest neighbour is then verified with the edit distance itself.

Defined cases: lines with fewer than ``MIN_CHARS`` characters have no neighbours (one edit of a short line
says little); their exact repeats go from ``min_repeat`` characters on; empty lines are kept; a null or empty text stays as it is; null ids sort first; rows equal
in doc_id and text are one document and share its result; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import cut
from evalgrid.llm.quality import let

MIN_CHARS = 20
SEGMENTS = 16


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_fp", F.xxhash64("text"))


def _hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _halves(line: Column, length: Column) -> Column:
    """Keys of what a line shares with a partner if the edit is in its latter or its former half."""
    def keys(n):
        h = F.floor(n / 2).cast("int")
        return F.array(F.struct(n.alias("n"), F.lit(0).alias("part"), _hash(n, F.lit(0), F.substr(line, F.lit(1), h)).alias("key")),
                       F.struct(n.alias("n"), F.lit(1).alias("part"), _hash(n, F.lit(1), F.substr(line, length - (n - h) + 1, n - h)).alias("key")))
    return F.concat(keys(length), keys(length - 1))


def _segments(line: Column, length: Column, n: Column, part: Column) -> Column:
    """Keys of the outside of each segment in the half that may hold the edit: part 0 the latter, 1 the former."""
    def edge(j):
        return F.floor(n * j / SEGMENTS).cast("int")
    first = F.when(part == 0, SEGMENTS // 2).otherwise(0)
    def one(j):
        a, b = edge(j), edge(j + 1)
        return F.struct(a.alias("from"), F.when(j == SEGMENTS - 1, length).otherwise(b).alias("to"),
                        _hash(n, j, F.substr(line, F.lit(1), a), F.substr(line, length - (n - b) + 1, n - b)).alias("key"))
    return F.transform(F.sequence(first, first + SEGMENTS // 2 - 1), one)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose ``key`` also belongs to another line.  A count by key, then a join with unique keys, so a hot key is split."""
    often = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("key")
    return rows.join(often, "key")


def find_removed(docs: DataFrame, min_chars: int = MIN_CHARS, min_repeat: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(first, removed): ``first`` has the first occurrence (doc_id, _fp, no) of each line of ``min_repeat`` (default
    ``min_chars``); ``removed`` those of them (same columns) of ``min_chars`` that have an earlier neighbour."""
    lines = (_keyed(docs.select("doc_id", "text")).select("doc_id", "_fp", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
             .where(F.length("line") >= (min_chars if min_repeat is None else min_repeat)).withColumn("length", F.length("line")))
    place = F.struct("doc_id", "_fp", "no")
    # a line is known by a 128-bit fingerprint; its text is fetched again for the few that need it
    keys = F.transform(_halves(F.col("line"), F.col("length")), lambda k: k["key"])
    first = cut(lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line", "length").alias("h2"), place.alias("place"),
                             F.when(F.col("length") >= min_chars, keys).otherwise(F.array().cast("array<bigint>")).alias("keys"))
                .groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min("keys").alias("keys"))
                .select("place", "keys", F.xxhash64("h1", "h2").alias("id")), "lines-first")

    half_keys = first.select("id", "place", F.posexplode("keys").alias("at", "key"))
    near = _shared(half_keys).groupBy("place").agg(F.collect_set("at").alias("halves"), F.min("id").alias("id"))
    wanted = near.groupBy("place.doc_id", "place._fp").agg(F.collect_list(F.struct("place.no", "id", "halves")).alias("lines"))
    picked = _keyed(docs.select("doc_id", "text"))
    kept = cut(picked.join(wanted, picked["doc_id"].eqNullSafe(wanted["doc_id"]) & (picked["_fp"] == wanted["_fp"]))
               .select(picked["doc_id"], picked["_fp"], F.explode(let(F.split("text", "\n", -1), lambda text: F.transform(
                   "lines", lambda l: F.struct(l["id"].alias("id"), l["no"].alias("no"), F.get(text, l["no"]).alias("line"), l["halves"].alias("halves"))))).alias("l"))
               .select("l.id", F.struct("doc_id", "_fp", "l.no").alias("place"), "l.line", "l.halves").dropDuplicates(["id"]), "lines-near")  # repeated rows bring a line again

    length = F.length("line")
    halves = kept.select("id", F.length("line").alias("length"), "line", F.explode("halves").alias("at")).select(
        "id", "line", "length", (F.col("length") - F.floor(F.col("at") / 2)).cast("int").alias("n"), (F.col("at") % 2).alias("part"))
    parts = halves.select("id", "length", "n", F.explode(_segments(F.col("line"), F.col("length"), F.col("n"), F.col("part"))).alias("s"))
    live = _shared(parts.select("id", "n", "s.*")).groupBy("id").agg(F.collect_set(F.struct("n", "from", "to")).alias("spans"))

    def variants(span):
        return F.when(span["from"] < span["to"], F.transform(F.sequence(span["from"], span["to"] - 1), lambda i: F.struct(
            (span["n"] == length).alias("same"), i.alias("at"),
            _hash(F.concat(F.substr("line", F.lit(1), i), F.substr("line", i + 2, length - i - 1))).alias("v")))).otherwise(
            F.array().cast("array<struct<same:boolean,at:int,v:bigint>>"))
    made = kept.join(live, "id").select("id", "place", F.explode(F.array_append(
        F.array_distinct(F.flatten(F.transform("spans", variants))),
        F.struct(F.lit(False).alias("same"), F.lit(-1).alias("at"), _hash(F.col("line")).alias("v")))).alias("x")).select(
        "id", "place", "x.same", F.when(F.col("x.same"), F.col("x.at")).otherwise(-1).alias("at"), (F.col("x.at") == -1).alias("whole"), "x.v")
    # substitutions: all members of (variant, place) are neighbours; insertions: the whole line and every longer line
    earliest = made.groupBy("same", "at", "v").agg(
        F.min("place").alias("any"), F.min(F.when(F.col("whole"), F.col("place"))).alias("whole_place"),
        F.min(F.when(~F.col("whole"), F.col("place"))).alias("longer_place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rival = F.when(F.col("same"), F.col("any")).when(F.col("whole"), F.col("longer_place")).otherwise(F.col("whole_place"))
    beaten = (made.join(earliest, ["same", "at", "v"]).select("place", rival.alias("rival")).where("rival < place").distinct())

    text = kept.select(F.col("place").alias("p"), "line")
    pairs = (beaten.join(text, F.col("place") == F.col("p")).select("place", "rival", F.col("line").alias("a"))
             .join(text, F.col("rival") == F.col("p")).where(F.levenshtein("a", "line", 1) >= 0))
    return first.select("place.*"), pairs.select("place.*").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_repeat: int | None = None) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and n_lines, n_removed long.

    ``min_chars``: least length of lines that are compared up to one edit; ``min_repeat``: of lines whose exact repeats
    go (default ``min_chars``; the query and the pipeline take 1, every line that is not empty)."""
    min_repeat = min_chars if min_repeat is None else min_repeat
    first, removed = find_removed(docs, min_chars, min_repeat)
    keep = ["doc_id", "_fp", "no"]
    stays = first.alias("f").join(removed.alias("r"), F.expr("f.doc_id <=> r.doc_id and f._fp = r._fp and f.no = r.no"), "left_anti")
    stays = stays.select(*keep).groupBy(F.col("doc_id").alias("_id"), F.col("_fp").alias("_key")).agg(F.collect_set("no").alias("_stays"))
    keyed = _keyed(docs)
    joined = keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed["_fp"] == stays["_key"]), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda line, i: (F.length(line) < min_repeat) | F.coalesce(F.array_contains("_stays", i), F.lit(False)))
    return joined.withColumn("_left", left).withColumns({
        "n_lines": F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0)).cast("long"),
        "n_removed": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("_left")).cast("long"),
        "text": F.array_join("_left", "\n")}).select(*docs.columns, "n_lines", "n_removed")

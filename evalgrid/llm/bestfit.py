"""Operator 11: best-fit packing of documents into sequences with a bounded number of open ones.

Each document becomes one run of token ids (its text's ids, then the end id); a run longer than a sequence is cut
into full sequences and a rest.  Pieces are placed online: the open sequence whose free space is the smallest that
holds the piece takes it.  Open sequences are found by a bitset keyed by free space, whose lowest bit at or
above a length is the best fit, so placing a piece costs the same whatever is open.  At most ``keep`` sequences are
open; to open another one, the fullest closes first, which gives up the least space.  The order of arrival is
free, so each task takes its pieces in runs of ``AHEAD`` and the longest of a run first: short pieces then fill what
long ones leave (on the given lengths 0.02 % more sequences than the tokens need, 1 % more without).

The ids are stored first; what is dealt out for placing are rows without ids, PER_TASK pieces or so to a task, so that the
sequences left open at a task's end (at most ``keep``) are few beside those it has filled however the input was split.
``sequences`` then brings each sequence's ids together.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; a repeated row is packed again; an
empty table gives no rows; extra columns are ignored.  Texts of any length are taken whole, and each id lies in
exactly one piece.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import cut
from evalgrid.llm.tokens import token_pieces

END_ID = 0
SEQ_LEN = 2048
KEEP = 4096
AHEAD = 4096
PER_TASK = 250_000


class OpenSequences:
    """At most ``keep`` open sequences of ``size`` places, by free space."""

    def __init__(self, size: int, keep: int):
        self.size, self.keep = size, keep
        self.bits = 0  # bit f: a sequence with f places free is open
        self.open: list[list[int]] = [[] for _ in range(size)]  # by free space, 1 to size - 1
        self.n_open = self.n_made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The number of the sequence that takes ``length`` places, and the place where they begin."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.n_made, self.size
            self.n_made += 1
            if length < free and self.n_open == self.keep:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.open[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        numbers = self.open[free]
        number = numbers.pop()
        if not numbers:
            self.bits ^= 1 << free
        self.n_open -= 1
        return number


def cut_documents(tokens: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Full sequences, then the rest if there is one."""
    rest = tokens % seq_len
    return np.stack([np.full_like(tokens, seq_len), rest], axis=1), np.stack([tokens // seq_len, (rest > 0).astype(np.int64)], axis=1)


def place(pieces: DataFrame, seq_len: int = SEQ_LEN, keep: int = KEEP, per_task: int = PER_TASK, ahead: int = AHEAD) -> DataFrame:
    """``pieces`` (a stored table with ``length``, 1 to ``seq_len``) with sequence_id and offset."""
    tasks = max(1, math.ceil(pieces.count() / per_task))
    kind = pieces.schema

    def run(batches):
        held = OpenSequences(seq_len, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, ahead):
                run_of = batch.slice(at, ahead)
                run_of = run_of.take(pa.array(np.argsort(-run_of.column("length").to_numpy(), kind="stable")))
                put = np.array([held.put(n) for n in run_of.column("length").to_pylist()], dtype=np.int64)
                number = (run_of.column("_part").to_numpy().astype(np.int64) << 40) + put[:, 0]
                rest = run_of.drop_columns(["_part"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(number), pa.array(put[:, 1])], names=[*rest.schema.names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", sequence_id long, offset long"
    return pieces.repartition(tasks).withColumn("_part", F.spark_partition_id()).mapInArrow(run, out)


def tokenize(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """The pieces with their ids, stored: row, doc_id, piece, start, length, ids, doc_tokens, ids_crc32."""
    pieces = token_pieces(docs, tokenizer_path, end_id, lambda tokens: cut_documents(tokens, seq_len))
    return cut(pieces.withColumn("ids_crc32", F.crc32("ids")), "bestfit-pieces")


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, keep: int = KEEP) -> DataFrame:
    """``tokenize``'s pieces without their ids, each with its sequence_id and offset; the keys to the ids are row and piece."""
    return place(pieces.drop("ids"), seq_len, keep)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, little-endian unsigned 32-bit), n_ids: each sequence's pieces joined in order, without padding.
    A sequence is bounded by its length, so no group here is large."""
    rows = placed.select("row", "piece", "sequence_id", "offset", "length").join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_ids"))

"""Operator 8: power-of-two packing.

Each document becomes one run of token ids (its text's ids, then the end id).  A run of n ids is cut
into full sequences of ``seq_len`` ids and then into the binary digits of the rest, longest first, so
every piece has a power-of-two length.  Pieces of one length form a bucket; each piece is a sequence
of its own, so no sequence crosses documents and none needs padding.

Defined cases: a null or empty text is the end id alone (one piece of length 1); a null doc_id stays
null; a repeated row is packed again under its own sequence ids; an empty table gives no rows; extra
columns are ignored.  Texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.tokens import TOKENIZER, WordEncoder, token_pieces  # noqa: F401

END_ID = 2
SEQ_LEN = 4096


def piece_lengths(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Full sequences first, then the powers of two of the rest in falling order."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(tokens: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """``piece_lengths`` of many documents: the powers of two from ``seq_len`` down, and how often each comes."""
    powers = seq_len >> np.arange(seq_len.bit_length())
    times = (tokens[:, None] // powers) % 2
    times[:, 0] = tokens // seq_len
    return powers, times


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, bucket (log2 of the length).  No shuffle: a piece is a sequence by itself."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    pieces = token_pieces(docs, tokenizer_path, end_id, lambda tokens: cut_documents(tokens, seq_len))
    return pieces.select(
        "doc_id", "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as one folder per length, for loaders that read equal lengths together."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)

"""Token ids of whole texts by a public vocabulary file, cut into pieces: the common part of the packing operators.

Encoding goes batch by batch in columns: a batch's texts are split into words, each distinct word is encoded once
(and remembered across batches), and the ids of all texts are gathered from those of their words.  The pieces of
a batch are slices of one buffer of ids, so no Python object is made for an id, a word's place or a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import Memo

TOKENIZER = "word_bpe_49k.json"
# Punctuation that the vocabulary's splitter keeps together as one run after a word.
TRAILING = ".,!?;:#$%&*"
# Text bytes that are encoded at once; bounds the arrays of a step, not the texts (a longer text is a step by itself).
STEP_BYTES = 8 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _printable_bytes() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text by its words.

    The vocabulary's splitter never joins across a space or line feed, so a text's ids are the ids of
    its words in order, and words repeat.  Plain words go straight to the merge model; any other word
    takes the tokenizer's whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _printable_bytes()
        self.memo = Memo(self._word)
        self.cores = Memo(self._letters)  # the same letters come with and without capitals and punctuation

    def _letters(self, text: str) -> list[int]:
        mapped = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(mapped)]

    def _word(self, word: str) -> list[int]:
        core = word.rstrip(TRAILING)
        if core.isalpha() and max(core) < "Ā":
            ids = self.cores[core.lower()]
            return ids + self.cores[word[len(core):]] if len(core) < len(word) else ids
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text]))[0]

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text's followed by ``end_id`` if given, and the n + 1 bounds of the
        texts in them.  A null text is empty."""
        n_texts = len(texts)
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), pattern="\n", replacement=" "), pattern=" ")
        coded = words.flatten().dictionary_encode()
        lists = list(map(self.memo.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter(chain.from_iterable(lists), "<u4", int(sizes.sum()))
        code = coded.indices.to_numpy()
        n = sizes[code]
        word_end = np.cumsum(n)
        total = int(word_end[-1]) if len(n) else 0
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[code] - (word_end - n), n) + np.arange(total)]
        offsets = words.offsets.to_numpy()
        bounds = np.concatenate(([0], word_end))[offsets - offsets[0]] if n_texts else np.zeros(1, np.int64)
        if end_id is None:
            return ids, bounds
        more = np.arange(n_texts + 1)
        out = np.full(total + n_texts, end_id, dtype="<u4")
        out[np.arange(total) + np.repeat(more[:-1], np.diff(bounds))] = ids
        return out, bounds + more


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder, with its memo, for each Python worker."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))


def _steps(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def token_pieces(docs: DataFrame, path: str, end_id: int, cut_lengths: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """One row per piece: row (a number of the document's row), doc_id, piece (from 0), start, length, ids (binary, little-endian
    unsigned 32-bit) and doc_tokens.  ``cut_lengths`` takes the documents' numbers of ids and returns two arrays with a row
    for each document: the lengths of its pieces in order, and how often each comes.  No shuffle."""
    def run(batches):
        encoder = encoder_of(path)
        for whole in batches:
            for batch in _steps(whole, 2):
                ids, bounds = encoder.encode_many(batch.column(2), end_id)
                tokens = np.diff(bounds)
                lengths, times = cut_lengths(tokens)
                per_doc = times.sum(axis=1)
                length = np.repeat(np.broadcast_to(lengths, times.shape).ravel(), times.ravel())
                end = np.cumsum(length)
                doc = np.repeat(np.arange(len(tokens)), per_doc)
                first = np.cumsum(per_doc) - per_doc
                data = pa.py_buffer(np.ascontiguousarray(ids))
                places = np.concatenate(([0], end)) * 4
                if places[-1] >= 1 << 31:  # a text of more than half a billion ids: offsets of 64 bits do not fit the schema
                    raise ValueError("a text has more ids than one batch can hold")
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(places.astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)),
                     pa.array(end - length - bounds[:-1][doc]), pa.array(length.astype(np.int64)), blobs, pa.array(tokens[doc])], schema=_PIECES)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids binary, doc_tokens long")

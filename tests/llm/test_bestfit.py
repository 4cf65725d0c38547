import math
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalgrid.llm import bestfit as B
from evalgrid.llm import queries
from evalgrid.llm.common import read_table
from evalgrid.llm.tokens import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)


class Scan:
    """The same rules by looking at every open sequence."""

    def __init__(self, size, keep):
        self.size, self.keep, self.open, self.made = size, keep, [], 0

    def put(self, length):
        fits = [x for x in self.open if x[1] >= length]
        if fits:
            best = min(fits, key=lambda x: (x[1], -x[2]))
        else:
            if length < self.size and len(self.open) == self.keep:
                self.open.remove(min(self.open, key=lambda x: (x[1], -x[2])))
            best = [self.made, self.size, 0]
            self.made += 1
            self.open.append(best)
        place = self.size - best[1]
        best[1] -= length
        best[2] = self.clock = getattr(self, "clock", 0) + 1  # of equal ones, the latest touched
        if not best[1]:
            self.open.remove(best)
        return best[0], place


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.lists(st.integers(1, 40), max_size=80))
def test_bitset_finds_the_best_fit(size, keep, lengths):
    fast, slow = B.OpenSequences(size, keep), Scan(size, keep)
    for n in lengths:
        n = min(n, size)
        assert fast.put(n) == slow.put(n)
        assert fast.n_open == len(slow.open) <= keep


def check_sequences(rows, size):
    """Every sequence is gapless from 0 and not over its size."""
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= size
    return len(at)


def test_round_trip(make_docs, odd_rows):
    rows = odd_rows + [(1, "Hello, world! " * 900), (2, "<|endoftext|> x"), (3, "É" * 9000)]
    pieces = B.tokenize(make_docs(rows), PATH)
    placed = B.pack(pieces)
    got = placed.collect()
    check_sequences(got, B.SEQ_LEN)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in B.sequences(pieces, placed).collect()}
    docs = {}
    for r in sorted(got, key=lambda r: (r.row, r.piece)):
        ids = whole[r.sequence_id][r.offset:r.offset + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        mine = docs.setdefault(r.row, (r.doc_id, []))[1]
        assert (r.piece, r.start) == (math.ceil(len(mine) / B.SEQ_LEN), len(mine))
        assert len(mine) % B.SEQ_LEN == 0
        mine += ids.tolist()
    want = sorted(((d, [*PLAIN.encode(t or "", add_special_tokens=False).ids, B.END_ID]) for d, t in rows), key=repr)
    assert sorted(docs.values(), key=repr) == want
    assert sum(len(x) for x in whole.values()) == sum(len(x) for _, x in want)
    empty = B.tokenize(make_docs([]), PATH)
    assert B.pack(empty).count() == 0 and B.sequences(empty, B.pack(empty)).count() == 0


def test_query_packs_close(spark, small_sf):
    got = queries.op11_bestfit(spark, small_sf).collect()
    n = check_sequences(got, B.SEQ_LEN)
    docs = read_table(spark, small_sf, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs}
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want and n <= 1.02 * sum(want.values()) / B.SEQ_LEN + 1


def test_few_open_sequences_and_many_tasks(spark):
    """Bounds of open sequences and tasks change how well it packs, not that it does."""
    pieces = spark.range(5000).selectExpr("id AS row", "cast(1 + pmod(xxhash64(id), 97) AS bigint) AS length")
    lower = pieces.selectExpr("sum(length) / 100.0 AS n").first().n
    for keep, per_task, ahead, at_most in ((4, 700, 4, 1.3), (256, 100_000, 256, 1.03)):
        rows = B.place(pieces, 100, keep, per_task, ahead).collect()
        assert len(rows) == 5000 and check_sequences(rows, 100) <= at_most * float(lower) + 1

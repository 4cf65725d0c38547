import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalgrid.llm import packing as P

PATH = public_tokenizers.path(P.TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)
ENCODER = P.WordEncoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aàÉß.,!' \n\t́<|endoftext> \x1c9"))))
def test_words_encode_like_the_whole_text(text):
    assert ENCODER.encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 50_000))
def test_pieces_are_powers_of_two(n):
    got = P.piece_lengths(n)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= P.SEQ_LEN for x in got)


def test_round_trip(make_docs, odd_rows, tmp_path):
    rows = odd_rows + [(1, "Hello, world! " * 900), (2, "<|endoftext|> x"), (3, "É" * 9000)]
    pieces = P.pack(make_docs(rows), PATH)
    got = pieces.collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    runs = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        runs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0 and 1 << r.bucket == r.length
    for doc, text in rows:
        want = [*PLAIN.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        mine, at = [], 0
        for r in runs[doc, len(want)]:
            if at == len(want):
                break
            assert r.start == at
            mine += np.frombuffer(r.ids, "<u4").tolist()
            at += r.length
        assert mine == want or doc == 904
    P.write_buckets(pieces, str(tmp_path / "pieces"))
    assert P.pack(make_docs([]), PATH).count() == 0

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from conftest_llm import odd_texts, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm import bpe, pretokens

CODER = bpe.Coder(bpe.default_path(), public_tokenizers.PATTERN)
CODEC = CODER.codec
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.rank, special_tokens={})


def digests(i, t):
    ids, raw = TIKTOKEN.encode_ordinary(t or ""), (t or "").encode()
    return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def test_round_trip(odd, empty):
    want = sorted((digests(i, t) for i, t in odd_texts()), key=repr)
    assert rows_of(bpe.round_trip(odd), "id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.round_trip(empty).collect() == []


def test_encode_and_decode(odd):
    own = bpe.encode(odd).cache()
    assert rows_of(own, "id", "ids") == sorted(((i, TIKTOKEN.encode_ordinary(t or "")) for i, t in odd_texts()), key=repr)
    assert rows_of(bpe.decode(own), "id", "decoded") == sorted(((i, bytearray((t or "").encode())) for i, t in odd_texts()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab '\n\tstmdrevl0_-é", max_size=60), max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = CODER.encode(texts)
    assert [g.tolist() for g in got] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(g) for g in got] == [t.encode() for t in texts]


def test_long_pieces_and_both_ways():
    pieces = [b"a" * 255, b"ab" * 300, b" " * 1000, b"x", bytes(range(256)) * 2, b"the"]
    flat, lengths = CODEC.encode_pieces(pieces)
    ends = np.cumsum(lengths)
    for p, a, b in zip(pieces, ends - lengths, ends, strict=True):
        assert flat[a:b].tolist() == CODEC._heap(p) and CODEC.decode(flat[a:b]) == p


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(pretokens, "BYTES", 500)
    texts = ["Some words, and more of them.  " * 200, "x" * 6000, "é" * 3000 + " " + "日本" * 2000, "a b " * 900 + "\n\n" * 40]
    got = CODER.encode(texts)
    assert [g.tolist() for g in got] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_table_that_overflows():
    made = []

    def make(pieces):
        made.extend(pieces)
        return np.array([len(p) for p in pieces], np.int32), np.ones(len(pieces), np.int64)

    table = pretokens.Table(make, kept=100)
    for k in range(30):
        pieces = [f"piece{k * 10 + j}".encode() * (1 + j % 4) for j in range(40)] + [b"a\0", b"a", b"a\0\0"]
        assert table.numbers(pretokens.cut_listed([pieces]))[0].tolist() == [len(p) for p in pieces]
    assert made.count(b"a") > 1 and len(table.code) < 1000

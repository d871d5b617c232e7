import random

import pytest
import regex
from conftest_llm import odd_texts, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm import pretokens, wordpiece
from tokenizers.models import WordPiece

SHOWN = {b: c for c, b in wordpiece.byte_alphabet().items()}


def shown(data):
    return "".join(SHOWN[b] for b in data)


class Library:
    """The library's greedy pieces; a word that no piece of begin begins is given to a model whose
    words begin with pieces that go on."""

    def __init__(self, begin, go_on):
        self.begin, self.go_on, self.model, self.other = set(begin), set(go_on), self.made(begin, go_on), self.made(go_on, go_on)

    def made(self, begin, go_on):
        tokens = ["[UNK]", *(shown(p) for p in begin), *("##" + shown(p) for p in go_on)]
        return WordPiece({t: k for k, t in enumerate(tokens)}, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix="##")

    def __call__(self, word):
        """(pieces, whether unknown)."""
        if len(word) > 500:  # the library takes long for these
            return self.greedy(word)
        model = self.model if any(word[:k] in self.begin for k in range(1, len(word) + 1)) else self.other
        got = [t.value for t in model.tokenize(shown(word))]
        return (1, True) if got == ["[UNK]"] else (len(got), False)

    def greedy(self, word):
        longest, at, n = max(map(len, self.begin | self.go_on)), 0, 0
        while at < len(word):
            k = next((k for own in ((self.begin, self.go_on) if at == 0 else (self.go_on,)) for k in range(longest, 0, -1) if word[at : at + k] in own and at + k <= len(word)), 0)
            if not k:
                return 1, True
            at, n = at + k, n + 1
        return n, False


def brute(model, word):
    return model(word)


@pytest.fixture(scope="module")
def public():
    return Library(*wordpiece.pieces_of(wordpiece.default_path()))


def test_count(odd, empty, public):
    want = []
    for i, t in odd_texts():
        own = [brute(public, w.encode()) for w in regex.findall(wordpiece.WORD, t or "")]
        want.append((i, len(own), sum(n for n, _ in own), sum(u for _, u in own)))
    assert rows_of(wordpiece.count(odd), "id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=repr)
    assert wordpiece.count(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=20))
def test_any_vocabulary(begin, go_on, words):
    begin, go_on, words = ([x.encode() for x in y] for y in (begin, go_on, words))
    got = wordpiece.Automaton(begin, go_on).counts(words)
    model = Library(sorted(set(begin)), sorted(set(go_on)))
    assert [(1, True) if n < 0 else (n, False) for n in got.tolist()] == [brute(model, w) for w in words]
    if begin or go_on:
        assert [model.greedy(w) for w in words] == [brute(model, w) for w in words]


def test_plain_cut():
    rng, full = random.Random(6), regex.compile(wordpiece.WORD)
    for _ in range(3000):
        text = "".join(rng.choices(" \n\tab09_-!'éÖ", k=rng.randint(0, 20)))
        cut = wordpiece.cut_plain([text.encode(), b"x"])
        assert [cut.raw[s : s + n].tobytes().decode() for s, n in zip(cut.starts, cut.lengths, strict=True)] == [*full.findall(text), "x"]
        assert cut.counts.tolist() == [len(full.findall(text)), 1]


def test_parts(monkeypatch, public):
    text = "some words " * 300 + "x" * 3000 + " 漢字" * 500
    want = [brute(public, w.encode())[0] for w in regex.findall(wordpiece.WORD, text)]
    monkeypatch.setattr(pretokens, "BYTES", 200)
    got = pretokens.by_text([text], wordpiece.splitter(), wordpiece.table(wordpiece.default_path()))[0]
    assert [abs(n) for n in got.tolist()] == want


@pytest.mark.parametrize("text", ["สวัสดีชาวโลก", "яблоко э", "뷁뛟 안녕"])
def test_words_without_a_beginning_are_spelled(spark, text, public):
    row = wordpiece.count(spark.createDataFrame([("x", text)], "doc_id string, text string")).first()
    assert row.id == "x" and row.n_unknown == 0 and row.n_tokens == sum(public(w.encode())[0] for w in regex.findall(wordpiece.WORD, text)) > row.n_words

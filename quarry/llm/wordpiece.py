"""Token counts: greedy word-piece lengths from a linear longest-match automaton.

The vocabulary's pieces stand in a trie, those that go on a word below a root of their own. A node
whose way on is missing has a failure link, to the node for the text that is left once the longest
pieces of what was read are taken off, and the number of pieces so taken. Each byte of a word moves
one step down, after as many failure links as pieces it costs, so the work is linear in the bytes,
and no piece is ever built: the counts of the links taken are summed. All words of a batch move in
step, a byte a round, through a hash table of (node, byte); a worker keeps the counts of words seen.

A word is a run of word characters or any other single character that is not white space. A word
that no piece for beginnings begins, as most words of some scripts, begins with a piece that goes on
words; one that the pieces can't spell at all counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; texts of any length are counted
whole, in parts, and words of any length too; rows that repeat or tie get the same counts; an empty
table gives an empty one; ids may be of any type; other columns of any name are passed by.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import pretokens
from quarry.llm.bpe import NONE, PairTable

WORD = r"\w+|[^\w\s]"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """From a byte-level vocabulary: its tokens behind a space begin words, the others go on."""
    with open(path) as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    byte = byte_alphabet()
    tokens = [bytes(byte[c] for c in t) for t in model["model"]["vocab"] if t not in special and all(c in byte for c in t)]
    begin = sorted({t[1:] for t in tokens if t[:1] == b" " and len(t) > 1})
    return begin, sorted({t for t in tokens if t[:1] != b" "})


class Automaton:
    """Counts the pieces of words; root is node 0, the root of pieces that go on node 1, where words
    begin too whose beginning is no piece below node 0."""

    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in child[at]:
                        child[at][b] = len(child)
                        child.append({})
                        whole.append(False)
                    at = child[at][b]
                whole[at] = True
        fail, popped = [-1] * len(child), [0] * len(child)
        fail[0] = 1  # a beginning that has no piece of its own
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in child[u].items():
                queue.append(v)
                if whole[v]:
                    fail[v], popped[v] = 1, 1
                    continue
                z, n = fail[u], popped[u]
                while z != -1 and b not in child[z]:
                    n += popped[z]
                    z = fail[z]
                if z != -1:
                    fail[v], popped[v] = child[z][b], n
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        edges = np.array([(u, b, v) for u, own in enumerate(child) for b, v in own.items()], np.int32).reshape(-1, 3)
        self.step = PairTable(*edges.T)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word, -1 if it can't be spelled."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int32)
        order = np.argsort(sizes, kind="stable")
        for part in np.array_split(order, len(words) // 50_000 + 1):
            text = np.frombuffer(b"".join(words[i] for i in part), np.uint8).astype(np.int32)
            out[part] = self._together(text, sizes[part])
        return out

    def _together(self, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        begins = np.cumsum(sizes) - sizes
        node, total, live = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32), np.flatnonzero(sizes > 0)
        dead = np.zeros(len(sizes), bool)
        place = 0
        while len(live):
            todo = live
            while len(todo):
                to = self.step(node[todo], text[begins[todo] + place])
                here = to != NONE
                node[todo[here]] = to[here]
                todo = self._back(todo[~here], node, total, dead)
            place += 1
            live = live[(sizes[live] > place) & ~dead[live]]
        todo = np.flatnonzero((sizes > 0) & ~dead & (node != 1))
        while len(todo):
            todo = self._back(todo, node, total, dead)
            todo = todo[node[todo] != 1]
        return np.where(dead, -1, total)

    def _back(self, todo: np.ndarray, node: np.ndarray, total: np.ndarray, dead: np.ndarray) -> np.ndarray:
        """Follows a failure link; returns the words that have one."""
        to = self.fail[node[todo]]
        dead[todo[to == -1]] = True
        total[todo] += self.popped[node[todo]]
        node[todo] = to
        return todo[to != -1]


def table(path: str) -> pretokens.Table:
    return pretokens.held(("word-pieces", path), lambda: _table(path))


def _table(path: str) -> pretokens.Table:
    automaton = Automaton(*pieces_of(path))

    def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return automaton.counts(words), np.ones(len(words), np.int64)

    return pretokens.Table(make)


def cut_plain(texts: list[bytes]) -> pretokens.Cut:
    """What WORD finds in plain texts: runs of letters, digits and _, other characters singly."""
    raw, ends = pretokens.joined(texts)
    kind = np.where(raw == 95, pretokens.LETTER, pretokens.CLASS[raw])
    kind[kind == pretokens.DIGIT] = pretokens.LETTER
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == pretokens.OTHER)
    cut = pretokens.marked(raw, begins, ends)
    words = kind[cut.starts] != pretokens.SPACE
    text = np.repeat(np.arange(len(ends)), cut.counts)[words]
    return pretokens.Cut(raw, cut.starts[words], cut.lengths[words], np.bincount(text, minlength=len(ends)))


@functools.lru_cache(maxsize=1)
def splitter() -> pretokens.Splitter:
    return pretokens.Splitter(WORD, cut_plain)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_words, n_tokens, n_unknown (words that are one unknown token): a row per row of docs."""
    path = path or default_path()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pretokens.batches(stream):
            found = [(len(x), int(np.abs(x).sum()), int((x < 0).sum())) for x in pretokens.by_text(texts, splitter(), table(path))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "n_words", "n_tokens", "n_unknown"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")

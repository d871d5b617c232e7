"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Pieces of like length stand as rows of one padded matrix of token ids. Each round, every row merges
its leftmost pair of minimum rank: the ranks of all pairs are looked up once in a hash table of
pairs, kept beside the matrix, and renewed at the two places a merge touches; rows then close the
gap, and rows without a pair left leave the matrix. Any two neighbours whose bytes together are a
token make a pair, and its rank is that token's id. Pieces of over MATRIX_BYTES bytes, where rounds
would cost the square of the length, are merged in the same order from a heap.

Defined results: null and empty texts have no ids; equal texts, as of rows that repeat or tie, have
equal ids whatever row they stand in; texts of any length are encoded whole, in parts whose ids are
joined; an empty table gives an empty one; ids of rows may be of any type and null; other columns of
any name are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import pretokens

MATRIX_BYTES = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from pairs of ids to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at, todo, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(todo):  # each free place takes one of the keys that want it; the others move on
            self.probes += 1
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        for _ in range(1, self.probes):
            todo = np.flatnonzero((held != keys) & (held != -1))
            if not len(todo):
                break
            at.flat[todo] = (at.flat[todo] + 1) & (len(self.keys) - 1)
            now = self.keys[at.flat[todo]]
            held.flat[todo] = now
            out.flat[todo] = np.where(now == keys.flat[todo], self.values[at.flat[todo]], NONE)
        return out


class Codec:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.pair = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        most = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(most)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(most)), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        found: list[np.ndarray | None] = [None] * len(pieces)
        width = 4
        at = np.argsort(sizes, kind="stable")
        while len(at):
            bucket, at = at[: (n := np.searchsorted(sizes[at], width, "right"))], at[n:]
            for part in np.array_split(bucket, len(bucket) * width // (1 << 20) + 1):
                if len(part):
                    self._matrix([pieces[i] for i in part], sizes[part], part, found)
            if width >= MATRIX_BYTES:
                for i in at:
                    found[i] = np.array(self._heap(pieces[i]), np.int32)
                break
            width = min(MATRIX_BYTES, width + max(4, width // 2))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([*found, np.zeros(0, np.int32)]), lengths

    def _matrix(self, pieces: list[bytes], sizes: np.ndarray, at: np.ndarray, found: list) -> None:
        n, width = len(pieces), int(sizes.max(initial=1)) or 1
        ids = np.full((n, width), -1, np.int32)
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        sizes = sizes.copy()
        ranks = np.full((n, width), NONE, np.int32)  # of the pair that begins here; the last place has none
        if width > 1:
            ranks[:, :-1] = np.where(filled[:, 1:], self.pair(ids[:, :-1], np.maximum(ids[:, 1:], 0)), NONE)
        while n:
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(n), j]
            done = best == NONE
            if done.any():
                for i, row, size in zip(at[done], ids[done], sizes[done], strict=True):
                    found[i] = row[:size].copy()
                go = ~done
                ids, ranks, sizes, at, j, best = ids[go], ranks[go], sizes[go], at[go], j[go], best[go]
                n = len(at)
                if not n:
                    break
                width = int(sizes.max())
                ids, ranks = ids[:, :width], ranks[:, :width]
            rows = np.arange(n)
            ids[rows, j] = best
            shifted = np.arange(width - 1)
            from_ = shifted + (shifted > j[:, None])
            ids = np.take_along_axis(ids, from_, 1)
            ranks = np.take_along_axis(ranks, shifted + (shifted >= j[:, None]), 1)
            sizes -= 1
            width -= 1
            right = np.minimum(j + 1, width - 1)
            ranks[rows, j] = np.where(j + 1 < sizes, self.pair(best, np.maximum(ids[rows, right], 0)), NONE)
            left = np.maximum(j - 1, 0)
            ranks[rows, left] = np.where(j > 0, self.pair(ids[rows, left], best), ranks[rows, left])

    def _heap(self, piece: bytes) -> list[int]:
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        word = self.bytes_of
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]

        def rank(i: int) -> int | None:
            return self.rank.get(word[ids[i]] + word[ids[after[i]]]) if after[i] != -1 else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] == -1 or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] != -1:
                before[after[i]] = i
            for k in (before[i], i):
                if k != -1 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
        return [x for x in ids if x != -1]

    def decode(self, ids: np.ndarray) -> bytes:
        return pretokens.gather(self.all_bytes, self.begins[ids], self.sizes[ids]).tobytes()


class Coder:
    """A codec with the pieces of a pattern that it has met."""

    def __init__(self, path: str, pattern: str):
        self.codec, self.split = Codec(path), pretokens.byte_level(pattern)
        self.table = pretokens.Table(self.codec.encode_pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        return pretokens.by_text(texts, self.split, self.table)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.codec.decode(ids)


def coder(path: str, pattern: str) -> Coder:
    return pretokens.held(("bpe", path, pattern), lambda: Coder(path, pattern))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _type(own: DataFrame) -> str:
    return own.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids array<int>: a row per row of docs."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for part, texts in pretokens.batches(stream):
            ids = own.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {_type(own)}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, decoded binary: the bytes of each row's ids; null ids are none."""
    path = path or default_path()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, default_pattern())
        for part in stream:
            texts = [own.decode(np.asarray(x or [], np.int64)) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary())], ["id", "decoded"])

    own = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"id {_type(own)}, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both
    digested where they are made, so that neither is moved."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for part, texts in pretokens.batches(stream):
            n, a, b = [], [], []
            for ids in own.encode(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {_type(own)}, n_tokens long, ids_sha256 string, decoded_sha256 string")

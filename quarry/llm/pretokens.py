"""Pieces of texts and their numbers, shared by the tokenizers: cut, look up, gather.

A vocabulary's merges never cross the pieces that its pattern cuts, so a piece is encoded once and
its numbers are kept in a bounded table; texts are put together from there by array gathers. Texts of
plain characters are cut by comparing the classes of neighbouring bytes, all texts of a batch at
once; others by the pattern itself."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps at most, and bytes of texts in hand at a time.
KEPT, BYTES = 500_000, 1_000_000

#: Texts of these characters alone are plain: ASCII and the letters of Latin-1.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
END, SPACE, LETTER, DIGIT, OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each byte of a plain text; 0 stands behind each text."""
    out = np.full(256, OTHER, np.uint8)
    out[0] = END
    out[list(b"\t\n\r ")] = SPACE
    out[list(b"0123456789")] = DIGIT
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    return out


CLASS = _classes()


_held: dict = {}


def held(key, make: Callable):
    """What a worker keeps from task to task: the thing that make() gives for a key, as long as no
    other is asked for. So workers that serve one operator after the other hold one's tables."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


@dataclass
class Cut:
    """Pieces of some texts: their bytes in raw, and how many each text has."""

    raw: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a 0 behind each and sixteen behind all, and the places of the first."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    return np.frombuffer(b"\0".join([*texts, bytes(16)]), np.uint8), ends


def marked(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Cut:
    """From marks where pieces, or the 0 behind a text, begin."""
    starts = np.flatnonzero(begins[: ends[-1] + 1])
    lengths = np.diff(starts, append=ends[-1] + 1)
    text = np.searchsorted(ends, starts)
    real = starts != ends[text]
    return Cut(raw, starts[real], lengths[real], np.bincount(text[real], minlength=len(ends)))


def cut_plain(texts: list[bytes]) -> Cut:
    """What the byte-level pattern cuts plain texts into: runs of a class, a last space before a
    run with it, other last white space alone, and the endings that follow an apostrophe."""
    raw, ends = joined(texts)
    kind = CLASS[raw]
    begins = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] > SPACE))  # of white space before a run
    begins[last] = True
    begins[last[raw[last] == 32] + 1] = False
    at = np.flatnonzero((raw[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER))
    if len(at):
        one, two = raw[at + 1], raw[at + 2]
        n = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        at, n = at[n > 0], n[n > 0]
        begins[at + 1] = False
        begins[at + 1 + n] = True
    return marked(raw, begins, ends)


def cut_listed(pieces: list[list[bytes]]) -> Cut:
    """Pieces that were cut elsewhere."""
    flat = list(itertools.chain.from_iterable(pieces))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    return Cut(np.frombuffer(b"".join([*flat, bytes(16)]), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array([len(p) for p in pieces], np.int64))


@dataclass
class Splitter:
    """Cuts texts by a pattern; `plain` cuts those of plain characters, alike."""

    pattern: str
    plain: Callable[[list[bytes]], Cut] | None = None

    def __post_init__(self):
        import regex

        self.full = regex.compile(self.pattern)

    def parts(self, text: str) -> Iterator[tuple[bool, str | Iterable[str]]]:
        """(plain, text) in parts of some BYTES, cut at spaces between other characters, where
        pieces begin whatever stands around; (False, pieces) for other texts, some at a time."""
        if self.plain and PLAIN.fullmatch(text):
            at = 0
            while at < len(text):
                to = at + BYTES
                found = re.compile(r"(?<=\S) (?=\S)").search(text, to, to + BYTES) if to < len(text) else None
                if found is None:
                    to = len(text)
                    if to - at > 4 * BYTES:
                        break  # no such space for long
                else:
                    to = found.start()
                yield True, text[at:to]
                at = to
            if at >= len(text):
                return
            text = text[at:]
        if len(text) <= BYTES:
            yield False, self.full.findall(text)
        else:
            found = (m.group() for m in self.full.finditer(text))
            while part := list(itertools.islice(found, BYTES // 8)):
                yield False, part


def byte_level(pattern: str) -> Splitter:
    import public_tokenizers

    return Splitter(pattern, cut_plain if pattern == public_tokenizers.PATTERN else None)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s:s + n] over starts and lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Table:
    """Pieces with an array of numbers each, made by `make` from a list of unknown pieces as
    (flat numbers, lengths); emptied once it has more than `kept` pieces.

    Pieces of at most sixteen bytes are their own keys, two words, in an open-addressing hash table
    that is asked for all pieces at once; longer ones, and those with a 0, are in a dictionary."""

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        self.make, self.kept, self.bits = make, kept, max(8, int(2 * kept).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.low, self.high, self.code = (np.zeros(1 << self.bits, t) for t in (np.uint64, np.uint64, np.int32))
        self.code -= 1  # free
        self.long: dict[bytes, int] = {}
        self.n, self.used, self.probes = 0, 0, 0
        self.flat, self.lengths, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64)

    def _room(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if n > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), old.dtype)]))
        return getattr(self, name)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The codes of keys, -1 for unknown ones."""
        at = self._home(low, high)
        out = self.code[at]
        todo = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.code) - 1)
            a = at[todo]
            out[todo] = self.code[a]
            todo = todo[(out[todo] >= 0) & ((self.low[a] != low[todo]) | (self.high[a] != high[todo]))]
        out[todo] = -1  # no key is further from home than that
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> None:
        at, todo, rounds = self._home(low, high), np.arange(len(low)), 0
        while len(todo):  # each free place takes one of the keys that want it; the others move on
            free = todo[self.code[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.low[at[put]], self.high[at[put]], self.code[at[put]] = low[put], high[put], codes[put]
            todo = todo[(self.code[at[todo]] != codes[todo])]
            at[todo] = (at[todo] + 1) & (len(self.code) - 1)
            rounds += 1
        self.probes = max(self.probes, rounds)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """New codes for new pieces."""
        flat, lengths = self.make(pieces)
        n, m = self.n + len(pieces), self.used + len(flat)
        self._room("flat", m)[self.used : m] = flat
        self._room("lengths", n)[self.n : n] = lengths
        self._room("starts", n)[self.n : n] = self.used + np.cumsum(lengths) - lengths
        codes = np.arange(self.n, n)
        self.n, self.used = n, m
        return codes

    def codes(self, cut: Cut) -> np.ndarray:
        raw, starts, sizes = cut.raw, cut.starts, cut.lengths
        if self.n > self.kept:
            self._clear()
        words = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low = words[starts] & mask[np.minimum(sizes, 8)]
        high = np.zeros(len(starts), np.uint64)
        over = np.flatnonzero(sizes > 8)
        high[over] = words[starts[over] + 8] & mask[np.minimum(sizes[over] - 8, 8)]
        odd = sizes > 16
        if not raw[: len(raw) - 16].all():  # a 0 in a piece would be lost in its key
            zeros = np.concatenate([[0], np.cumsum(raw == 0)])
            odd |= zeros[starts + sizes] > zeros[starts]
        out = self._find(low, high)
        new = np.flatnonzero((out < 0) & ~odd)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            first = order[differs]
            codes = self._add([raw[s : s + n].tobytes() for s, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)])
            self._insert(low[first], high[first], codes)
            out[order] = codes[np.cumsum(differs) - 1]
        odd = np.flatnonzero(odd)
        if len(odd):
            pieces = [raw[s : s + n].tobytes() for s, n in zip(starts[odd].tolist(), sizes[odd].tolist(), strict=True)]
            if new := [p for p in dict.fromkeys(pieces) if p not in self.long]:
                self.long.update(zip(new, self._add(new).tolist(), strict=True))
            out[odd] = [self.long[p] for p in pieces]
        return out

    def numbers(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the pieces in a row, and how many each has."""
        codes = self.codes(cut)
        lengths = self.lengths[codes]
        return gather(self.flat, self.starts[codes], lengths), lengths


def by_text(texts: list[str], split: Splitter, table: Table) -> list[np.ndarray]:
    """The numbers of each text."""
    own: list[list[np.ndarray]] = [[] for _ in texts]
    held: dict[bool, list] = {True: [], False: []}
    size = 0

    def flush() -> None:
        for plain, group in held.items():
            if group:
                parts = [p for _, p in group]
                cut = split.plain([p.encode() for p in parts]) if plain else cut_listed([[x.encode() for x in p] for p in parts])
                numbers, lengths = table.numbers(cut)
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *cut.counts])]
                for (k, _), a, b in zip(group, ends[:-1], ends[1:], strict=True):
                    own[k].append(numbers[a:b])
                group.clear()

    for k, text in enumerate(texts):
        for plain, part in split.parts(text):
            held[plain].append((k, part))
            size += len(part)
            if size >= BYTES:
                flush()
                size = 0
    flush()
    nothing = np.zeros(0, np.int32)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else nothing for p in own]


def batches(stream: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of record batches with the texts of a column, null as empty, that have about BYTES
    bytes of text or a single row. The batches themselves are as large as the session says, in rows and
    in bytes."""
    for whole in stream:
        at, group = 0, np.cumsum(np.asarray(pc.binary_length(whole.column(column)).fill_null(0), np.int64)) // BYTES
        for cut in [*np.flatnonzero(np.diff(group)) + 1, whole.num_rows]:
            if cut > at:
                part = whole.slice(at, cut - at)
                yield part, [x or "" for x in part.column(column).to_pylist()]
            at = cut

"""License scans: phrases in place, and an exact set-similarity join of text blocks with templates.

A template is the set of the words of a licence notice. A block, taken as the set of its words, is a
line of a text, or a run of consecutive words over a line end, as many as the template's notice has
(the whole text, where that has fewer), that touches no line which meets the template by itself: so a
notice is found however it is wrapped, and marks of comments are no words. The join finds every pair
in which the block holds at least THRESHOLD of the template's words:

* Words are ordered by the number of documents of the corpus that have them, the rarest first; words
  that no template has come last, in any order. One pass over the corpus counts them.
* Prefix filter: of a template of n words that needs o in common, the n - o + 1 first in that order
  can't all be missing, so only blocks with one of them are looked at. Those words are found in the
  text as substrings, and nothing else of the text is cut into words. A run of words that holds one
  crosses an end of the line that the word stands in, so only runs over those ends are looked at.
* Length filter: a block needs o words. Positional filter: where the first word in common stands at
  place i of the template and j of the block's own words of templates, no more than the lesser rest
  can follow.
* What is left is verified by counting.

Beside it, ``phrases`` are found where their words stand one behind the other, over line ends too.

Defined results: null and empty texts have no words, places or labels and score 0; texts and lines of
any length are read whole, in parts; rows that repeat or tie get the same result; ids may be of any type
and null; an empty table gives an empty result; other columns of any name are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import pretokens
from quarry.llm.common import BYTE_GAP, BYTE_WORD, byte_words

#: Phrases and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and the labels they give.
TEMPLATES = (
    ("agpl-3", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software"),
)
THRESHOLD = 0.8

def is_word() -> np.ndarray:
    """By byte, whether it belongs to a word once A-Z are lower-cased."""
    return np.array([bool(re.match(BYTE_WORD, bytes([b]))) for b in range(256)])


@dataclass
class Template:
    label: str
    words: tuple[bytes, ...]  # in the global order
    needed: int  # words in common
    length: int  # of the notice, in words

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


@dataclass
class Join:
    """The templates in the global order, and an index of their prefixes."""

    templates: list[Template]

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        notices = [(label, re.findall(BYTE_WORD, text.encode().lower())) for label, text in templates]
        sets = [(label, set(own), len(own)) for label, own in notices]
        order = sorted({w for _, s, _ in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates = [Template(label, tuple(sorted(s, key=self.rank.__getitem__)), math.ceil(threshold * len(s) - 1e-9), n) for label, s, n in sets]
        self.index: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.prefix:
                self.index.setdefault(w, []).append(k)

    def candidates(self, low: bytes, wordly: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """Lines (from, to) with a prefix word of a template, and these templates."""
        found: dict[tuple[int, int], set[int]] = {}
        for w, templates in self.index.items():
            at = low.find(w)
            while at != -1:
                end = at + len(w)
                if (at and wordly[low[at - 1]]) or (end < len(low) and wordly[low[end]]):
                    at = low.find(w, at + 1)
                    continue
                line = low.rfind(b"\n", 0, at) + 1, low.find(b"\n", end)
                line = line if line[1] != -1 else (line[0], len(low))
                found.setdefault(line, set()).update(templates)
                at = low.find(w, line[1])  # the line is found; on with the next
        return found

    def wrapped(self, low: bytes, end: int, k: int, taken: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """The first of the best blocks of template k over the line end before byte `end` that meets
        the threshold and touches none of the lines taken."""
        t = self.templates[k]
        before, after = _before(low, end, t.length - 1), _after(low, end, t.length - 1)
        near, best = before + after, []
        for i in range(max(1, len(near) - t.length + 1)):
            own = near[i : i + t.length]
            if not i < len(before) < i + len(own) or any(own[0][0] < b and a < own[-1][1] for a, b in taken):
                continue
            common = len({w for _, _, w in own}.intersection(t.words))
            if common >= t.needed and (not best or common / len(t.words) > best[0][3]):
                best = [(own[0][0], own[-1][1], k, common / len(t.words))]
        return best

    def blocks(self, low: bytes, wordly: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(from, to, template, containment) of every line that meets the threshold, and of the best
        block over each line end that does."""
        found = self.candidates(low, wordly)
        lines = self.lines(low, found)
        taken: dict[int, list[tuple[int, int]]] = {}
        for a, b, k, _ in lines:
            taken.setdefault(k, []).append((a, b))
        ends = sorted({(end, k) for (a, b), templates in found.items() for k in templates for end in (a, b + 1) if 0 < end < len(low)})
        return sorted({*lines, *(x for end, k in ends for x in self.wrapped(low, end, k, taken.get(k, [])))})

    def lines(self, low: bytes, found: dict[tuple[int, int], set[int]]) -> list[tuple[int, int, int, float]]:
        """Those of the candidates that meet the threshold."""
        out = []
        for (a, b), templates in sorted(found.items()):
            own = set().union(*byte_words(low[a:b]))
            ranks = sorted(self.rank[w] for w in own & self.rank.keys())
            for k in sorted(templates):
                t = self.templates[k]
                if len(own) < t.needed:
                    continue
                theirs = [self.rank[w] for w in t.words]
                first = next(r for r in theirs if r in ranks)
                i, j = theirs.index(first), ranks.index(first)
                if min(len(theirs) - i, len(ranks) - j) < t.needed:
                    continue
                common = len(own.intersection(t.words))
                if common >= t.needed:
                    out.append((a, b, k, common / len(t.words)))
        return out


def _after(low: bytes, at: int, n: int) -> list[tuple[int, int, bytes]]:
    """(from, to, word) of the first n words from a line's begin on."""
    return [(m.start(), m.end(), m[0]) for m in itertools.islice(re.compile(BYTE_WORD).finditer(low, at), n)]


def _before(low: bytes, at: int, n: int) -> list[tuple[int, int, bytes]]:
    """The last n words before a line's begin, in order."""
    size = 64 * n
    while True:
        first = max(0, at - size)
        found = [(m.start(), m.end(), m[0]) for m in re.compile(BYTE_WORD).finditer(low, first, at)]
        if first == 0 or len(found) > n:  # the first may be cut
            return found[-n:]
        size *= 4


def places(low: bytes, phrases: Iterable[str]) -> list[tuple[int, str]]:
    """(byte offset, phrase) wherever a phrase's words stand one behind the other. A phrase whose
    first word the text lacks isn't looked for."""
    out = []
    for phrase in phrases:
        own = phrase.encode().split()
        if all(w in low for w in own):
            one = rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?=" + BYTE_GAP.join(map(re.escape, own)) + rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F]))"
            out += [(m.start(), phrase) for m in re.finditer(one, low)]
    return sorted(out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _typed(own: DataFrame, rest: str) -> str:
    """The schema of what an operator gives: id as it is, and the rest."""
    return f"id {own.schema['id'].dataType.simpleString()}, {rest}"


def frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """Of each word of a template, the number of documents that have it; summed in the cluster, and
    as many numbers as the templates have words."""
    vocabulary = {w for _, text in templates for w in re.findall(BYTE_WORD, text.encode().lower())}

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for _, texts in pretokens.batches(stream):
            for text in texts:
                count.update(set().union(*(vocabulary.intersection(part) for part in byte_words(text.encode().lower()))))
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, begin, end (bytes of the block in the text), label, containment: every block that
    meets the threshold of a template."""
    join = Join(frequencies(docs, templates, text_col), templates, threshold)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordly = is_word()
        for part, texts in pretokens.batches(stream):
            at, rows = [], []
            for i, text in enumerate(texts):
                found = join.blocks(text.encode().lower(), wordly)
                at += [i] * len(found)
                rows += [(a, b, join.templates[k].label, c) for a, b, k, c in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            own = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *own], ["id", "begin", "end", "label", "containment"])

    own = _texts(docs, id_col, text_col)
    return own.mapInArrow(run, _typed(own, "begin long, end long, label string, containment double"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row of
    docs. The score is 1 with a phrase, else the best containment that meets the threshold, or 0."""
    join = Join(frequencies(docs, templates, text_col), templates, threshold)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordly = is_word()
        for part, texts in pretokens.batches(stream):
            rows = []
            for text in texts:
                low = text.encode().lower()
                inside = wordly[np.frombuffer(low, np.uint8)]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                found, lines = places(low, phrases), join.blocks(low, wordly)
                at = [int(np.count_nonzero(begins[:k])) for k in ((found[0][0], found[-1][0]) if found else ())]
                base = {phrases[p] for _, p in found}
                labels = base | {join.templates[k].label for _, _, k, _ in lines}
                score = 1.0 if found else max((c for *_, c in lines), default=0.0)
                rows.append((int(np.count_nonzero(begins)), len(found), *(at or (None, None)), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    own = _texts(docs, id_col, text_col)
    return own.mapInArrow(run, _typed(own, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"))

"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by some numbers (FEATURES). Each is cut into bins at quantiles of the training
rows. Boosting goes round the features again and again: for one at a time, a tree of two levels over
its bins is fitted to the gradient of the logistic loss, and a small share of it is added to the
feature's lookup table. Then the pairs of features whose joint bins explain most of what is left get
tables of their own in the same way, with trees that split one feature and then the other. A score
is the intercept plus one entry of each table.

Training rows are at most `most` rows of either class (a bounded, documented sample in the order of
a hash of the id), weighted to the classes' shares; only their numbers, not their texts, come to the
driver.

Defined results: null texts are empty; an empty text has all numbers 0 and is scored by their bins;
very long texts are described whole, words in parts; labels that are null are not learnt from, nor
those of ids that documents lack; of an id that repeats, and so of rows that tie, any one may be
learnt; with no labels of a class the score is the share of the other; an empty table gives an empty
result; ids may be of any type; other columns of any name are not read, and those to keep may have any
name but id and score.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import pretokens
from quarry.llm.common import PART
from quarry.llm.toxicity import sample, scored

FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "spaces", "stops", "symbols", "bars", "bangs", "non_ascii",
    "word_length", "longest_word", "distinct_words", "repeated_words", "line_length", "short_lines", "distinct_lines", "top_byte",
)
SAMPLE, BINS, COARSE, PAIRS = 10_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 200, 60, 0.1, 1.25

_CLASS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)), "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789", "spaces": b" \t\r\n", "stops": b".,;:?", "symbols": b"#$%&*@^~_=+<>\\/{}[]", "bars": b"|", "bangs": b"!", "non_ascii": bytes(range(128, 256)),
}


def _words(text: str) -> Iterator[list[str]]:
    """What white space parts, some PART characters at a time."""
    at = 0
    while at < len(text):
        end = re.compile(r"\s").search(text, at + PART) if at + PART < len(text) else None
        to = end.start() if end else len(text)
        yield text[at:to].split()
        at = to


def numbers(text: str) -> list[float]:
    """The values of FEATURES for a text."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, longest, repeated, last, distinct = 0, 0, 0, None, set()
    for words in _words(text):
        n += len(words)
        longest = max(longest, max(map(len, words), default=0))
        repeated += sum(map(operator.eq, words, itertools.islice(words, 1, None))) + (words[:1] == [last])
        distinct.update(words)
        last = words[-1] if words else last
    lines, each = text.split("\n"), max(1, n)
    shares = [float(count[np.frombuffer(c, np.uint8)].sum()) / len(raw) for c in _CLASS.values()]
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), *shares,
        len(text) / each, float(np.log1p(longest)), len(distinct) / each, repeated / each,
        float(np.log1p(len(text) / len(lines))), sum(len(x) < 25 for x in lines) / len(lines), len(set(lines)) / len(lines), float(count.max()) / len(raw),
    ]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value for each bin, of the best tree of two levels over the bins' sums of gradients and
    second derivatives; a side of a split has at least LEAST of the latter's weight."""

    def split(a: int, b: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0.0, a
        lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
        gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
        gain[(lh < LEAST) | (rh < LEAST)] = 0
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    cuts = [0, len(g)]
    gain, at = split(0, len(g))
    if gain > 0:
        cuts = sorted({0, len(g), at, *(c for a, b in ((0, at), (at, len(g))) for v, c in [split(a, b)] if v > 0)})
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table of a split of the first feature and one of the second on either side of it,
    over joint bins, and its gain; a side of the latter split with less than LEAST of the second
    derivatives' weight gets no value."""
    best, gain = np.zeros_like(g), 0.0
    for first in range(1, g.shape[0]):
        out, total = np.zeros_like(g), 0.0
        for a, b in ((0, first), (first, g.shape[0])):
            cg, ch = np.cumsum(g[a:b].sum(0)), np.cumsum(h[a:b].sum(0))
            sides = (cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            left, right = (np.where(h_ >= LEAST, g_ / (h_ + 1), 0) for g_, h_ in sides)
            each = left * sides[0][0] + right * sides[1][0]
            k = int(each.argmax()) + 1
            total += float(each[k - 1])
            out[a:b, :k], out[a:b, k:] = -left[k - 1], -right[k - 1]
        if total > gain:
            best, gain = out, total
    return best, gain


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)  # of the features' bins
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """The scores of rows of numbers."""
        z = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], "right") for a, b, _ in self.pairs for k in (a, b)}
        for a, b, table in self.pairs:
            z += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
    """The model of rows x with labels y and weights w."""
    share = float((w * y).sum() / w.sum()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(intercept=50.0 if share else -50.0)
    w = w * (len(y) / w.sum())
    cut = lambda n: [np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) for k in range(x.shape[1])]
    model = Model(cut(BINS), [], cut(COARSE), [], float(np.log(share / (1 - share))))
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return w * (p - y), w * p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            step = RATE * np.clip(_tree(*(np.bincount(own, v, len(model.tables[k])) for v in (g, h))), -4, 4)
            model.tables[k] += step
            z += step[own]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]

    def joint(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = rough[a] * shape[1] + rough[b]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    wide = [k for k, e in enumerate(model.coarse) if len(e)]
    strength = {(a, b): _quadrants(*joint(a, b))[1] for a, b in itertools.combinations(wide, 2)}
    chosen = sorted(strength, key=lambda ab: (-strength[ab], ab))[:PAIRS]
    tables = {ab: np.zeros((len(model.coarse[ab[0]]) + 1, len(model.coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            step = RATE * np.clip(_quadrants(*joint(a, b))[0], -4, 4)
            tables[a, b] += step
            z += step[rough[a], rough[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def described(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, the columns to keep, and x, the texts' numbers."""
    if taken := {"id", "x"} & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep can't be named {sorted(taken)}")
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(k).alias(f"__keep_{n}") for n, k in enumerate(keep)])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pretokens.batches(stream, "__text"):
            yield pa.RecordBatch.from_arrays([part.column("__id"), *(part.column(2 + n) for n in range(len(keep))), pa.array([numbers(t) for t in texts], pa.list_(pa.float64()))], ["id", *keep, "x"])

    types = [f.dataType for f in own.schema.fields]
    return own.mapInArrow(run, T.StructType([T.StructField("id", types[0]), *(T.StructField(k, t) for k, t in zip(keep, types[2:], strict=True)), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    texts, count = sample(docs, labels, label_col, learn, most, id_col, text_col)
    rows = described(texts, "id", "text", "y").dropDuplicates(["id"]).toArrow().sort_by("id")
    y = np.asarray(rows.column("y"), np.int64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    got = np.bincount(y, minlength=2)
    return fit(x, y, np.array([count[k] / got[k] for k in y.tolist()]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, score (0 to 1), and the columns to keep. The model is a few hundred numbers."""

    def scorer() -> Callable[[list[str]], Iterable[float]]:
        return lambda texts: model.score(np.array([numbers(t) for t in texts]).reshape(-1, len(FEATURES)))

    return scored(docs, scorer, id_col, text_col, *keep)

"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, for the lengths in ORDERS,
hashed to 2**BITS places. From labelled rows, each feature gets its log-count ratio, the logarithm
of the share of toxic rows that have it over that of the others, both smoothed. Features whose shares
differ by SURE standard errors, those with the strongest evidence first, are kept, and a logistic
regression with a penalty is fitted to features scaled by their ratios, so a score is one sum of
weights over the distinct n-grams of a whole text.

The labelled sample is bounded, by parameters, in rows and in characters: at most `most` rows of
either class, in the order of a hash of the id, whose texts have at most LONGEST characters (all
texts are scored, however long, and whole), and of these as many as have MOST_CHARS together; rows are
weighted so that the classes count as often as they do among all labelled rows.

Defined results: null texts are empty; an empty text is scored by the intercept; labels that are
null are not learnt from, nor those of ids that documents lack; of an id that repeats, and so of rows
that tie, any one may be learnt; with no labels of a class the score is the share of the other; an
empty table gives an empty result; ids may be of any type; other columns of any name are not read, and
those to keep may have any name but id and score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import pretokens

ORDERS, BITS = (3, 4, 5), 22
SAMPLE, LONGEST, MOST_CHARS, FEATURES = 4000, 200_000, 48_000_000, 20_000
SMOOTH, SURE, PENALTY, STEPS = 0.5, 5.0, 1e-4, 120
#: Characters of a text in hand at a time.
PART = 1 << 20
#: Places that are summed at a time in the fit.
AT_ONCE = 1 << 20


class NGrams:
    """The distinct hashed n-grams of texts; holds one mark for each place of the hash."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.bits = orders, bits
        self.mark, self.now = np.full(1 << bits, -1, np.int32), 0

    def places(self, text: str) -> np.ndarray:
        """The places of the text's n-grams, each once."""
        found, kept = [], max(self.orders) - 1
        if self.now + len(self.orders) * (len(text) + len(text) // PART + 1) * 2 >= 1 << 31:
            self.mark, self.now = np.full(1 << self.bits, -1, np.int32), 0
        first = self.now
        text = text.lower()
        for at in range(0, max(1, len(text)), PART):
            x = np.frombuffer(text[max(0, at - kept) : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = np.zeros(len(x), np.uint64)
            for n in range(1, max(self.orders) + 1):
                if len(x) < n:
                    break
                h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
                if n in self.orders:
                    p = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
                    p = p[self.mark[p] < first]
                    order = np.arange(self.now, self.now + len(p), dtype=np.int32)
                    self.mark[p] = order  # of like places the last one's mark stays
                    found.append(p[self.mark[p] == order])
                    self.now += len(p)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    places: np.ndarray  # of the features kept, FEATURES at most
    weights: np.ndarray
    intercept: float

    def scorer(self) -> Callable[[str], float]:
        grams, by_place = NGrams(), np.zeros(1 << BITS, np.float32)
        by_place[self.places] = self.weights

        def score(text: str) -> float:
            z = self.intercept + float(by_place[grams.places(text)].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


class _Sums:
    """For each of n groups, the sum of the values at its places; made once for many values. Places
    stand by group, and some AT_ONCE of them are summed at a time."""

    def __init__(self, size: np.ndarray, places: np.ndarray):
        self.n, self.some, self.places = len(size), np.flatnonzero(size), places
        self.ends = np.cumsum(size)[self.some]
        self.starts = self.ends - size[self.some]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        at = 0
        while at < len(self.some):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + AT_ONCE, "right")))
            first, last = self.starts[at], self.ends[to - 1]
            out[self.some[at:to]] = np.add.reduceat(values[self.places[first:last]], self.starts[at:to] - first)
            at = to
        return out


def constant(share: float) -> Model:
    """What there is to say with labels of one class or none."""
    return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 50.0 if share else -50.0)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """The model of these rows; weights count rows several times or in part."""
    labels = np.asarray(labels, np.float64)
    share = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return constant(share)
    grams = NGrams()
    counts = np.zeros((2, 1 << BITS), np.float32)
    for text, y in zip(texts, labels, strict=True):
        counts[int(y), grams.places(text)] += 1
    n = [float((labels == k).sum()) for k in (0, 1)]
    p, q = ((counts[k] + SMOOTH) / (n[k] + 2 * SMOOTH) for k in (1, 0))
    spread = (counts.sum(0) + SMOOTH) / (sum(n) + 2 * SMOOTH)
    sure = np.flatnonzero(np.abs(p - q) >= SURE * np.sqrt(spread * (1 - spread) * (1 / n[0] + 1 / n[1])))
    p, q = p[sure].astype(np.float64), q[sure].astype(np.float64)
    best = np.argsort(-np.abs(np.log(p / q) * (p - q)), kind="stable")[:FEATURES]
    kept, r = sure[best], np.log(p / q)[best]
    del counts, spread
    column = np.full(1 << BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    own = [c[c >= 0] for c in (column[grams.places(t)] for t in texts)]
    del grams, column
    size, columns = np.array([len(c) for c in own], np.int64), np.concatenate(own)
    del own
    pairs = columns.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(size), dtype=np.uint64), size)
    pairs.sort()  # in place
    by_row = _Sums(size, columns)
    by_column = _Sums(np.bincount(columns, minlength=len(kept)), pairs.view(np.uint32)[::2].astype(np.int32))  # the lower half is the row
    del pairs, columns
    scale = weights / weights.sum()

    beta, b0 = np.zeros(len(kept)), float(np.log(share / (1 - share)))
    m, v, rate = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0.05
    for step in range(1, STEPS + 1):
        z = b0 + by_row(r * beta)
        error = scale * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        gradient = np.append(r * by_column(error) + PENALTY * beta, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        beta, b0 = beta - move[:-1], b0 - move[-1]
    return Model(kept.astype(np.int32), (r * beta).astype(np.float32), b0)


def remainder(id_: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids count as 0."""
    return F.pmod(F.coalesce(F.crc32(id_.cast("string").cast("binary")), F.lit(0).cast("long")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, most: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y) of at most `most` rows of either class, and how many rows each class has. The
    ids drawn are at most 2 * most, and broadcast."""
    own = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    count = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    drawn = [own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    drawn = drawn[0].union(drawn[1]).dropDuplicates(["id"])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id"), count


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a sample, fitted by one task, as the sample is bounded; what comes to the driver
    is the model."""
    rows, count = sample(docs, labels, label_col, learn, most, id_col, text_col)
    rows = rows.withColumn("length", F.length(F.coalesce("text", F.lit("")))).filter(F.col("length") <= LONGEST).dropDuplicates(["id"])
    drawn = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # of the sample, in one task
    rows = rows.withColumn("upto", F.sum("length").over(drawn)).filter(F.col("upto") <= MOST_CHARS).sortWithinPartitions("id")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in stream:
            texts += [t or "" for t in batch.column("text").to_pylist()]
            labels += batch.column("y").to_pylist()
        got = np.bincount(np.array(labels, np.int64), minlength=2)
        model = fit(texts, np.array(labels), np.array([count[k] / got[k] for k in labels]))
        yield pa.RecordBatch.from_arrays([pa.array([model.places], pa.list_(pa.int32())), pa.array([model.weights], pa.list_(pa.float32())), pa.array([model.intercept])], ["places", "weights", "intercept"])

    found = rows.select("text", "y").mapInArrow(run, "places array<int>, weights array<float>, intercept double").collect()  # one row
    return Model(np.array(found[0].places, np.int32), np.array(found[0].weights, np.float32), found[0].intercept) if found else constant(0.0)


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], Iterable[float]]], id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, score, and the columns to keep."""
    if taken := {"id", "score"} & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep can't be named {sorted(taken)}")
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(k).alias(f"__keep_{n}") for n, k in enumerate(keep)])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for part, texts in pretokens.batches(stream, "__text"):
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(list(score(texts)), pa.float64()), *(part.column(2 + n) for n in range(len(keep)))], ["id", "score", *keep])

    types = [f.dataType for f in own.schema.fields]
    return own.mapInArrow(run, T.StructType([T.StructField("id", types[0]), T.StructField("score", T.DoubleType()), *(T.StructField(k, t) for k, t in zip(keep, types[2:], strict=True))]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, score (0 to 1), and the columns to keep. The model, FEATURES places and weights at
    most, is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scorer() -> Callable[[list[str]], Iterable[float]]:
        one = held.value.scorer()
        return lambda texts: map(one, texts)

    return scored(docs, scorer, id_col, text_col, *keep)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at the threshold or more; all columns stay. Rows are
    dropped where they are scored, so none is moved."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = held.value.scorer()
        for part, texts in pretokens.batches(stream, text_col):
            yield part.filter(pa.array([one(t) < threshold for t in texts]))

    return docs.mapInArrow(run, docs.schema)

"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its shingles of SHINGLE consecutive words (a text of fewer words, but not
none, is one shingle), each a 64-bit hash. Documents of equal sets are one node from the start. The
steps:

1. A pass over the texts makes each set's digest and HASHES MinHash values.
2. Sets that agree on ROWS values of one of the bands meet in a bucket. Pairs' MinHash values are
   compared STEP at a time; with m of n equal, and a uniform prior, similarity t or more has the
   posterior probability P[Binomial(n + 1, t) <= m], and the pair is dropped as soon as that falls
   below TOLERANCE. First each member of a bucket is compared with the bucket's least, its leader:
   once for each two sets, however many buckets they share. Members that last are led. Then, only in
   buckets that have others, those are compared with all members; pairs that are known to be in one
   tree are skipped. The pairs that last connect every two sets that any bucket's pairs do.
3. The components of these edges have all pairs that may be linked. The texts are dealt by key, those
   of the nodes are cut into shingles, every pair of a component goes through the same pruning, and
   what lasts is verified by the exact Jaccard similarity.

Buckets and components of more than BLOCK members, or of more shingles than BLOCK_BYTES hold, are cut
into blocks, and each pair of blocks is a group of its own that any task may take; pairs are counted where they are found and never become
rows. So a hot group costs the tasks that its pairs need, in bounded memory each, and rows in
proportion to members times blocks. At similarity 0.8 a pair is missed by all bands with a
probability of 5e-8, and by the pruning with at most about TOLERANCE a step.

Defined results: null and empty texts, and those without words, have no shingles, no links and a
class each; very long texts are cut whole, in parts; rows that repeat are linked like any equal sets,
and of those that repeat id and text any one may be kept; a null id ranks below any other, and ids may
be of any type that has an order; an empty table gives an empty result; other columns of any name are
left alone, and pass through ``deduplicate``. Rows get a number in one scan, which is written; later
scans, whose files may be dealt to other partitions, are matched with it by a key made of id and text.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import pretokens
from quarry.llm.common import BYTE_GAP, BYTE_WORD, dropped, row_key, scope, written
from quarry.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP, TOLERANCE = 128, 4, 16, 1e-9
#: Members of a block, and bytes of their shingles, that blocks are planned for.
BLOCK, BLOCK_BYTES = 500, 16 << 20
#: Pairs that are compared together, and sets in a worker's forest.
PAIRS, TREES = 100_000, 200_000
#: Bytes that are hashed together; a longer word is hashed by itself.
PART = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    a, b = rng.integers(0, 1 << 63, (2, HASHES), np.uint64)
    return a << np.uint64(1) | np.uint64(1), b


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Words:
    """64-bit hashes of words, of all words of some bytes at once. A word's hash is the sum over its
    bytes of a random number for the byte times a power of an odd base, modulo 2**64, mixed: the
    difference of two running sums over the bytes, times a power of the base's inverse."""

    def __init__(self):
        rng = np.random.default_rng(20_240_502)
        self.of = rng.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | rng.integers(0, 2, 256, np.uint64)
        self.base = int(rng.integers(1 << 32, 1 << 62)) | 1
        self.wordly = np.array([bool(re.match(BYTE_WORD, bytes([b]))) for b in range(256)])
        self.power = self.inverse = np.zeros(0, np.uint64)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of raw, and where they begin."""
        data = np.frombuffer(raw, np.uint8)
        if len(data) + 1 > len(self.power):
            own, back = np.full(len(data) + PART, self.base, np.uint64), np.full(len(data) + PART, pow(self.base, -1, 1 << 64), np.uint64)
            own[0] = back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(own), np.multiply.accumulate(back)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.wordly[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of[data] * self.power[: len(data)], out=sums[1:])
        sizes = ends - starts
        out = _mixed((sums[ends] - sums[starts]) * self.inverse[starts] + sizes.astype(np.uint64) * np.uint64(_MULTIPLIER))
        for k in np.flatnonzero(sizes > PART):
            out[k] = self.long(raw[starts[k] : ends[k]])
        return out, starts

    def long(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of_text(self, low: bytes) -> np.ndarray:
        """The hashes of the words of a text of any length, some PART bytes at a time."""
        found, at = [], 0
        while at < len(low):
            gap = re.compile(BYTE_GAP).search(low, at + PART) if at + PART < len(low) else None
            to = gap.start() if gap else len(low)
            if to - at > 2 * PART:  # the word that ends at `to` is long
                inside = self.wordly[np.frombuffer(low, np.uint8, PART, at)]
                begin = at + int(PART - inside[::-1].argmin()) if not inside.all() else at
                found.append(self(low[at:begin])[0])
                if to - begin > PART:
                    found.append(np.array([self.long(low[begin:to])], np.uint64))
                else:
                    found.append(self(low[begin:to])[0])
            else:
                found.append(self(low[at:to])[0])
            at = to
        return np.concatenate([*found, np.zeros(0, np.uint64)])


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_MULTIPLIER) + words[k : len(words) - n + 1 + k]
    return _mixed(out)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    hashed = pretokens.held("word hashes", _Words)
    low = [t.encode().lower() for t in texts]
    out: list[np.ndarray | None] = [None] * len(texts)
    groups, room = [[]], PART
    for k, t in enumerate(low):
        if len(t) >= PART:
            words = hashed.of_text(t)
            out[k] = _distinct(_rolled(words, min(size, max(1, len(words)))))
            continue
        if len(t) >= room:
            groups.append([])
            room = PART
        groups[-1].append(k)
        room -= len(t) + 1
    for group in groups:
        if not group:
            continue
        words, starts = hashed(b"\0".join([low[k] for k in group]))
        begins = np.cumsum([0, *(len(low[k]) + 1 for k in group)])
        ends = np.searchsorted(starts, begins)  # places of each text's words among all
        runs = _rolled(words, size)
        for k, a, b in zip(group, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = _distinct(runs[a : b - size + 1] if b - a >= size else _rolled(words[a:b], max(1, b - a)))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of each set, none of which is empty; uint32."""
    out = np.empty((len(sets), HASHES), np.uint32)
    a, b = _parameters()
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 100_000):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat(x * a[k] + b[k], starts) >> np.uint64(32)
        at = to
    return out


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the least number of equal values at which the posterior
    probability that the similarity is at the threshold is not below the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def lasting(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) of rows of sig that no step drops."""
    same = np.zeros(len(left), np.int32)
    for k, m in enumerate(least):
        if not len(left):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        same += (sig[left, part] == sig[right, part]).sum(1, dtype=np.int32)
        keep = same >= m
        left, right, same = left[keep], right[keep], same[keep]
    return left, right


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of like group whose sides are (0, 1), or (2, 2) in a group of one block,
    some PAIRS at a time. Rows of a group stand together, side 0 before side 1."""
    ends = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    held_l, held_r, size = [], [], 0
    sizes = np.diff(ends)
    for s in np.unique(sizes):
        if 1 < s <= 64:  # groups of like size together
            a, b = np.triu_indices(s, 1)
            first = ends[:-1][sizes == s]
            for part in np.array_split(first, len(first) * len(a) // PAIRS + 1):
                left, right = (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
                ok = (side[left] == 2) | (side[left] != side[right])
                yield left[ok], right[ok]
    for first, s in zip(ends[:-1], sizes, strict=True):
        if s <= 64:
            continue
        for i in range(first, first + s):
            others = np.arange(i + 1, first + s)
            if side[i] != 2:
                others = others[side[others] != side[i]] if side[i] == 0 else others[:0]
            held_l.append(np.full(len(others), i))
            held_r.append(others)
            size += len(others)
            if size >= PAIRS:
                yield np.concatenate(held_l), np.concatenate(held_r)
                held_l, held_r, size = [], [], 0
    if size:
        yield np.concatenate(held_l), np.concatenate(held_r)


class _Forest:
    """Edges that join two trees, of those it is shown. It forgets them once it has over TREES nodes,
    which costs some edges more."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def joins(self, x: bytes, y: bytes) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def trees(self, names: list[bytes]) -> np.ndarray:
        """The same number for names that are in one tree."""
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(self.root(x), len(number)) for x in names], np.int64)

    def bounded(self) -> None:
        if len(self.up) > TREES:
            self.up.clear()


def _groups(stream: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream that is sorted by keys, some thousand rows at a time, with the
    group's number on each row."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = np.asarray(t.column(k))
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in stream:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            t = pa.Table.from_batches(held)
            n = numbered(t)
            cut = int(np.searchsorted(n, n[-1]))  # the last group may go on
            if cut:
                yield t.slice(0, cut), n[:cut]
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        t = pa.Table.from_batches(held)
        yield t, numbered(t)


def _matrix(t: pa.Table, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), "<u4").reshape(-1, HASHES)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, key, set (16 bytes, null without shingles), n, sig: a row per row of docs."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pretokens.batches(stream):
            sets = shingles(texts)
            full = [s for s in sets if len(s)]
            sig = iter(minhashes(full)) if full else iter(())
            own = [(xxhash.xxh3_128_digest(s.tobytes()), next(sig).tobytes()) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("id"), part.column("key"), pa.array([a for a, _ in own], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array([b for _, b in own], pa.binary())],
                ["row", "id", "key", "set", "n", "sig"],
            )

    own = _texts(docs, id_col, text_col)
    return own.mapInArrow(run, f"row long, id {own.schema['id'].dataType.simpleString()}, key binary, set binary, n int, sig binary")


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _one_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("set"), blocks).cast("int")


def _dealt(members: DataFrame, key: str, own: Column, others: Column) -> DataFrame:
    """members once for each pair of blocks (p, q), of their own block and each of others (an array),
    that they belong to; side is 0 in p, 1 in q, 2 where p is q."""
    dealt = members.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumns({
        "p": F.least("own", "other"), "q": F.greatest("own", "other"),
        "side": F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1),
    }).drop("own", "other").repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "side")


def candidates(sets: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """u, v: edges that last, which connect all that the lasting pairs of any bucket connect."""
    least = least_matches(threshold, tolerance)

    def bands(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            sig = _matrix(t).astype(np.uint64).reshape(t.num_rows, -1, ROWS)
            keys = np.broadcast_to(np.arange(sig.shape[1], dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(ROWS):
                keys = _mixed(keys * np.uint64(_MULTIPLIER) + sig[:, :, k])
            at = np.repeat(np.arange(t.num_rows), sig.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("set").take(pa.array(at))], ["bucket", "set"])

    def lead(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            t, n = pa.Table.from_batches([batch]), batch.num_rows
            if n:
                sig = np.concatenate([_matrix(t), _matrix(t, "other")])
                kept = pa.array(lasting(sig, np.arange(n), np.arange(n, 2 * n), least)[0])
                yield pa.RecordBatch.from_arrays([batch.column("set").take(kept), batch.column("leader").take(kept)], ["set", "leader"])

    def prune(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for t, group in _groups(stream, ("bucket", "p", "q")):
            forest.bounded()
            sig, names, side, new = _matrix(t), t.column("set").to_pylist(), np.asarray(t.column("side")), []
            for x, leader in zip(names, t.column("leader").to_pylist(), strict=True):
                if leader is not None:
                    forest.joins(x, leader)
            for left, right in _pairs(group, side):
                tree = forest.trees(names)
                apart = tree[left] != tree[right]
                for a, b in zip(*lasting(sig, left[apart], right[apart], least), strict=True):
                    if forest.joins(names[a], names[b]):
                        new.append((names[a], names[b]))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.binary()), pa.array([b for _, b in new], pa.binary())], ["u", "v"])

    band = written(sets.select("set", "sig").mapInArrow(bands, "bucket long, set binary"), "bands")
    shared = written(band.groupBy("bucket").agg(F.count("*").alias("total"), F.min("set").alias("leader")).filter("total > 1"), "buckets")
    members = written(band.join(shared.select("bucket", "leader"), "bucket").filter("set <> leader"), "members")
    sig = sets.select("set", "sig")
    both = members.select("set", "leader").distinct().join(sig, "set").join(sig.withColumnsRenamed({"set": "leader", "sig": "other"}), "leader")
    led = written(both.select("set", "leader", "sig", "other").mapInArrow(lead, "set binary, leader binary"), "led")
    state = members.join(led.withColumn("led", F.lit(True)), ["set", "leader"], "left").select("bucket", "set", F.when(F.col("led"), F.col("leader")).alias("leader"))
    state = written(state, "states")
    counts = state.groupBy("bucket").agg(F.count_if(F.col("leader").isNull()).alias("free"), F.count("leader").alias("led"))
    open_ = state.join(written(counts.filter("free > 0 and free + led > 1"), "open"), "bucket")
    open_ = written(open_, "open-members").join(sig, "set")
    free, led_ = _blocks("free"), _blocks("led")
    own = F.when(F.col("leader").isNull(), _one_of(free)).otherwise(free + _one_of(F.greatest(led_, F.lit(1))))
    others = F.sequence(F.lit(0), F.when(F.col("leader").isNull(), free + led_).otherwise(free) - 1)
    rest = _dealt(open_, "bucket", own, others).select("bucket", "p", "q", "side", "set", "leader", "sig").mapInArrow(prune, "u binary, v binary")
    return led.select(F.col("set").alias("u"), F.col("leader").alias("v")).union(rest)


def verified(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """set, other, links: rows whose other is null add to a set's links (to documents of other
    sets), the others are edges, a spanning forest with some over. nodes: set, component, key (of
    a document that has it), copies, n (shingles)."""
    least, ratio = least_matches(threshold, tolerance), Fraction(str(threshold))

    def fetch(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pretokens.batches(stream):
            sets = shingles(texts)
            sig = minhashes(sets) if sets else ()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("set", "component", "copies", "total")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["set", "component", "copies", "total", "shingles", "sig"])

    def verify(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for t, group in _groups(stream, ("component", "p", "q")):
            forest.bounded()
            sig, names, side, copies = _matrix(t), t.column("set").to_pylist(), np.asarray(t.column("side")), np.asarray(t.column("copies"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            starts = np.cumsum(sizes) - sizes
            distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
            flag = np.zeros(len(distinct), bool)
            links, new = np.zeros(len(names), np.int64), []
            for left, right in _pairs(group, side):
                left, right = lasting(sig, left, right, least)
                order = np.argsort(left, kind="stable")
                left, right = left[order], right[order]
                for own in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1):
                    if not len(own):
                        continue
                    i, j = left[own[0]], right[own]
                    mine = codes[starts[i] : starts[i] + sizes[i]]
                    flag[mine] = True
                    common = np.add.reduceat(flag[pretokens.gather(codes, starts[j], sizes[j])], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
                    flag[mine] = False
                    j = j[common * ratio.denominator >= (sizes[i] + sizes[j] - common) * ratio.numerator]
                    links[i] += copies[j].sum()
                    links[j] += copies[i]
                    new += [(names[i], names[k]) for k in j if forest.joins(names[i], names[k])]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in some] + [a for a, _ in new], pa.binary()), pa.array([None] * len(some) + [b for _, b in new], pa.binary()), pa.array([*links[some].tolist(), *[0] * len(new)], pa.int64())],
                ["set", "other", "links"],
            )

    texts = docs.groupBy("key").agg(F.first("text").alias("text"))  # rows may repeat id and text
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    total = nodes.groupBy("component").agg(blocks.alias("total"))  # blocks of each
    own = written(nodes.join(total, "component"), "nodes")
    own = texts.join(own, "key").select("set", "component", "copies", "total", "text").mapInArrow(fetch, "set binary, component binary, copies long, total int, shingles binary, sig binary")
    dealt = _dealt(own, "component", _one_of(F.col("total")), F.sequence(F.lit(0), F.col("total") - 1))
    return dealt.select("component", "p", "q", "side", "set", "copies", "shingles", "sig").mapInArrow(verify, "set binary, other binary, links long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row, id, class_id, n_links, kept, key, once: a row per row of docs. Links are other rows of similarity
    at the threshold or more; a class is what links connect, its id the least id in it; the row of
    that id (the first, if repeated) is kept; once says whether that row has the same key."""
    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            full = written(signatures(docs, id_col, text_col), "signatures")
            sets = full.filter("set is not null").groupBy("set").agg(F.min(F.struct("id", "row", "key")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
            sets = written(sets, "sets", outer=1)
            own = written(full.select("row", "id", "key", "set"), "rows", outer=2)
        with scope(docs.sparkSession):
            nodes = components(candidates(sets, threshold))
            nodes = nodes.withColumnRenamed("node", "set").join(sets.select("set", F.col("first.key").alias("key"), "copies", "n"), "set")
            nodes = written(nodes, "nodes", outer=1)
        found = written(verified(_texts(docs, id_col, text_col).select("key", "text"), nodes, threshold), "links")
        classes = components(found.filter("other is not null").select(F.col("set").alias("u"), F.col("other").alias("v")))
        links = found.filter("other is null").groupBy("set").agg(F.sum("links").alias("links"))
        some = sets.select("set", "first", "copies").join(classes.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left")
        some = written(some.filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "set")), "linked")
        first = written(some.groupBy("component").agg(F.min("first").alias("class")), "classes")
        some = some.join(first, "component").select("set", "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        some = written(some, "linked-sets", outer=1)
    return own.join(some, "set", "left").select(
        "row", "id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("class").isNull() | (F.col("class.row") == F.col("row"))).alias("kept"),
        "key", (F.col("key") == F.col("class.key")).alias("once"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class; all columns stay."""
    out = join(docs, id_col, text_col, threshold).filter(~F.col("kept")).select("key", "once")
    return dropped(docs, out, id_col, text_col)

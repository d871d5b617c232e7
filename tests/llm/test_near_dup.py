from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import frame, odd_texts, rows_of, words
from quarry.llm import components, near_dup


def shingles(text):
    own = words(text)
    return frozenset(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()


def brute(rows):
    """(id, class id, links) of each row, and the number of classes, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common * 10 >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[root(k)].append(rows[k][0])
    name = {r: None if None in own else min(own) for r, own in classes.items()}
    return sorted(((rows[k][0], name[root(k)], links[k]) for k in range(len(rows))), key=repr), len(classes)


def test_join(odd, empty):
    want, classes = brute(odd_texts())
    got = near_dup.join(odd).cache()
    assert rows_of(got, "id", "class_id", "n_links") == want
    assert got.filter("kept").count() == classes
    assert near_dup.join(empty).collect() == []


@pytest.mark.parametrize("bound", [("BLOCK", 7), ("BLOCK_BYTES", 3000)])
def test_blocks(spark, monkeypatch, bound):
    """Groups of several blocks, in buckets and in components, lose and double no pair."""
    monkeypatch.setattr(near_dup, *bound)
    rows = odd_texts()[-100:]
    assert rows_of(near_dup.join(frame(spark, rows)), "id", "class_id", "n_links") == brute(rows)[0]


@pytest.mark.parametrize("block", [500, 5])
def test_chains(spark, monkeypatch, block):
    """Texts that are linked to their neighbours alone, in one class: buckets with members that are
    unlike their leader, and members that are like neither. Other chains stand beside it."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng, rows = np.random.default_rng(12), []
    for chain in range(3):
        text = [f"w{chain}x{k}" for k in rng.integers(0, 10**6, 400)]
        rows += [(1000 * chain + k, " ".join(text[4 * k : 4 * k + 100])) for k in range(60)]
    rows += [(5000 + k, rows[k][1]) for k in range(0, 60, 7)]
    got = near_dup.join(frame(spark, rows))
    assert rows_of(got, "id", "class_id", "n_links") == brute(rows)[0]
    assert {r.class_id for r in got.collect()} == {0, 1000, 2000}


def test_ids_of_another_type(spark):
    rows = [("b", "one two three four five six"), ("a", "One two three four five six"), (None, "other"), ("c", None)]
    got = near_dup.join(spark.createDataFrame(rows, "name string, text string"), "name")
    assert rows_of(got, "id", "class_id", "n_links") == sorted([("b", "a", 1), ("a", "a", 1), (None, None, 0), ("c", "c", 0)], key=repr)


def test_deduplicate(odd):
    out = near_dup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == brute(odd_texts())[1]


def test_pruning_bounds():
    least = near_dup.least_matches(0.8, 1e-9)
    assert list(least) == sorted(least) and 60 < least[-1] < 90
    assert near_dup.least_matches(0.8, 1e-2)[-1] > least[-1]


@pytest.mark.parametrize("share", [0.3, 0.8, 0.95])
def test_minhash_estimates(share):
    rng = np.random.default_rng(4)
    n = 2000
    common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), np.uint64)]) for _ in range(2))
    sig = near_dup.minhashes([a, b])
    assert abs((sig[0] == sig[1]).mean() - share) < 0.13
    kept = near_dup.lasting(sig, np.array([0]), np.array([1]), near_dup.least_matches(0.8))[0]
    assert bool(len(kept)) == (share >= 0.8)


@pytest.mark.parametrize("size", [2, 5, 64, 65, 150])
def test_pairs(size):
    group = np.repeat([0, 1], size)
    for side, want in ((np.full(2 * size, 2), size * (size - 1)), (np.tile([0] * (size // 2) + [1] * (size - size // 2), 2), 2 * (size // 2) * (size - size // 2))):
        pairs = [(int(a), int(b)) for left, right in near_dup._pairs(group, side) for a, b in zip(left, right, strict=True)]
        assert len(pairs) == len(set(pairs)) == want and all(group[a] == group[b] for a, b in pairs)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(70)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    rows = rows_of(got, "node", "component")
    assert len(rows) == len(set(rows)) and set(rows) == {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_long_texts_in_parts(monkeypatch):
    """Words are hashed alike wherever they stand and however a text is cut."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k * k % 331}" for k in range(3000)), "é " * 500 + "x" * 290 + " y" * 9, "a" * 180 + " " + "b" * 90 + " c", ",".join("".join(rng.choice(list("abÉ. "), 12)) for _ in range(400)), "", " . ", "one two", "z" * 5000]
    whole = [x.tolist() for x in near_dup.shingles(texts)]
    assert [x.tolist() for t in texts for x in near_dup.shingles([t])] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]
    for part in (5001, 6000, 20_000):
        monkeypatch.setattr(near_dup, "PART", part)
        assert [x.tolist() for x in near_dup.shingles(texts)] == whole
    monkeypatch.setattr(near_dup, "PART", 100)  # now some words are long
    small = [x.tolist() for x in near_dup.shingles(texts)]
    assert [len(x) for x in small] == [len(x) for x in whole] and small[0] == whole[0] and small[3] == whole[3]
    assert [x.tolist() for t in texts for x in near_dup.shingles([t])] == small
    assert near_dup.shingles(["q " * 70 + "x" * 290 + " y"])[0].tolist() == near_dup.shingles(["q " * 20 + "x" * 290 + " y"])[0].tolist()


@pytest.mark.parametrize("seed", range(3))
def test_shingles_are_told_apart(seed):
    """As many hashes as there are shingles, and in common what the texts have in common."""
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("abcabc  é-"), rng.integers(0, 400))) for _ in range(300)]
    found, want = [set(x.tolist()) for x in near_dup.shingles(texts)], [shingles(t) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in want]
    assert all(len(found[a] & found[b]) == len(want[a] & want[b]) for a in range(0, 300, 7) for b in range(300))

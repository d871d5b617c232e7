import hashlib

import pytest
from conftest_llm import frame, odd_texts, rows_of, words
from quarry.llm import contamination
from quarry.llm.common import settings

ITEMS = [(1, "item", None), (2, "item", ""), (3, "item", "river"), (4, "item", "word word word"), (10, "item", None), (11, "item", ".;"), (12, "item", None)]


@pytest.fixture(scope="module")
def items(spark):
    texts = dict(odd_texts())
    rows = [(i, t) for i, _, t in ITEMS] + [(20, " ".join(texts[5 * 0 + 3].split()[5:30])), (21, texts[2]), (21, texts[2]), (22, "nothing of this stands anywhere in the documents at all today my friend"), (None, " ".join(texts[9].split()[:12])), (100, texts[301].upper() if 301 in texts else "x"), (23, "one two")]
    return rows


def brute(rows, items, window=10):
    windows = {}
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).add("None" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        own, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(own) - n + 1):
                if (g := tuple(own[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        found.discard("None")
        out.append((i, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs, benchmark):
    return sorted(((r.id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in contamination.report(docs, benchmark).collect()), key=repr)


def test_report(spark, odd, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(odd_texts(), items)
    assert got(odd, benchmark) == want and any(r[2] for r in want)


@pytest.mark.parametrize("bound", [("BROADCAST", 0), ("BROADCAST_BYTES", 100)])
def test_without_broadcast(spark, odd, items, monkeypatch, bound):
    monkeypatch.setattr(contamination, *bound)
    assert got(odd, spark.createDataFrame(items, "item_id long, text string")) == brute(odd_texts(), items)


def test_empty(spark, odd, empty, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    none = benchmark.limit(0)
    assert got(empty, benchmark) == [] and got(empty, none) == []
    assert got(odd, none) == brute(odd_texts(), [])


def test_decontaminate(spark, odd, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = contamination.decontaminate(odd, benchmark)
    clean = [r[0] for r in brute(odd_texts(), items) if not r[2]]
    assert out.columns == odd.columns and sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, clean))


def brute_near(rows, items, slop, window=10):
    """The number of items of which every word of a window stands at most `slop` places from its own,
    counted from some start."""
    out = []
    for i, t in rows:
        places, found = {}, set()
        for k, w in enumerate(words(t)):
            places.setdefault(w, []).append(k)
        for item, text in items:
            own = words(text)
            for at in range(max(1, len(own) - window + 1) if own else 0):
                starts = [{p - k + d for p in places.get(w, ()) for d in range(-slop, slop + 1)} for k, w in enumerate(own[at : at + window])]
                if item is not None and set.intersection(*starts):
                    found.add(item)
        out.append((i, len(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slop", [1, 2])
def test_near(spark, odd, items, slop):
    rows = [*odd_texts(), (600, "alpha x beta"), (601, "alpha x x x x beta"), (602, "beta alpha"), (603, "alpha alpha beta beta")]
    items = [*items, (50, "alpha beta"), (51, "beta alpha beta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.report(frame(spark, rows), benchmark, slop=slop)
    assert rows_of(got, "id", "n_near") == brute_near(rows, items, slop)
    exact = sorted(((r.id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got.collect()), key=repr)
    assert exact == brute(rows, items) and all(r.n_near >= r.n_items for r in got.collect())


@pytest.mark.parametrize("slop", [0, 1])
def test_no_posting_is_moved(spark, odd, items, slop):
    """Lists are intersected by row where they stand: nothing is shuffled, nor any list broadcast."""
    own = contamination.Items(spark.createDataFrame(items, "item_id long, text string"))
    postings = contamination.index(odd, own)
    terms = contamination.ranked(own, postings)
    with settings(spark, contamination.IN_PLACE | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = contamination._met(postings, terms, slop)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 3 and "Bucketed: false" not in plan and "hashpartitioning" not in plan


def test_an_index_is_asked_again(spark, odd, items):
    own = contamination.Items(spark.createDataFrame(items, "item_id long, text string"))
    postings = contamination.index(odd, own)
    for slop in (0, 2, 1):
        assert rows_of(contamination.summary(own, postings, slop), "id", "n_near") == brute_near(odd_texts(), items, slop)


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "two"), (None, None)], "doc_id string, text string")
    got = contamination.report(docs, spark.createDataFrame([("i", "one two")], "item_id string, text string"))
    assert rows_of(got, "id", "n_hit") == [("a", 2), ("b", 0), (None, 0)]


def test_native(spark, odd, items):
    plan = contamination.report(odd, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

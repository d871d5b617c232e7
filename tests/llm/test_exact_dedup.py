import hashlib
import random

from conftest_llm import odd_texts, rows_of
from pyspark.sql import functions as F
from quarry.llm import exact_dedup
from quarry.llm.common import ascii_lower, written


def normal(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[normal(t)]
        out.append((i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(normal(t)).hexdigest()))
    return sorted(out, key=repr), {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}


def test_groups(odd):
    got = exact_dedup.groups(odd).cache()
    want, keeps = brute(odd_texts())
    assert rows_of(got, "id", "keep_id", "group_size", "text_sha256") == want
    kept = got.filter("kept").collect()
    assert len(kept) == len(keeps) and sorted((r.id for r in kept), key=repr) == sorted(keeps.values(), key=repr)


def test_identifiers_that_collide_are_refused(odd):
    tried = (F.length, lambda c: F.substring(c, 1, 3), F.xxhash64)
    assert rows_of(exact_dedup.groups(odd, tried=tried), "id", "keep_id", "group_size") == rows_of(exact_dedup.groups(odd), "id", "keep_id", "group_size")
    try:
        exact_dedup.groups(odd, tried=(F.length,))
    except ValueError:
        return
    raise AssertionError("lengths can't tell chunks apart")


def test_chunks_make_the_text(odd):
    lowered = odd.select(ascii_lower(F.col("text")).alias("t"))
    assert lowered.filter(F.array_join(exact_dedup.chunks(F.col("t")), "") != F.col("t")).count() == 0
    assert lowered.filter(F.array_max(F.transform(exact_dedup.chunks(F.col("t")), lambda c: F.length(c))) > exact_dedup.MAX_CHUNK).count() == 0


def test_chunks_settle_after_an_edit(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(20_000))
    df = spark.createDataFrame([(text,), ("begins otherwise " + text,)], "t string")
    a, b = (set(r.c) for r in df.select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert len(a & b) > 0.9 * len(a)


def test_deduplicate(odd, empty):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == len(brute(odd_texts())[1])
    assert exact_dedup.deduplicate(empty).collect() == [] and exact_dedup.groups(empty).collect() == []


def test_lower_changes_ascii_only(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = written(spark.createDataFrame([("".join(points[k : k + 50]) + "Az",) for k in range(0, len(points), 50)], "t string"), "points")
    bad = [r for r in df.select("t", ascii_lower(F.col("t")).alias("low")).collect() if r.t.encode().lower() != r.low.encode()]
    assert bad == []


def test_native(odd):
    plan = exact_dedup.groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

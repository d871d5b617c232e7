import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import odd_texts, rows_of
from pyspark.sql import functions as F
from quarry.llm import sharding


def test_assign(spark, odd):
    rows = sharding.assign(odd, 8).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_texts()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    load, places, by_slot = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        places[r.shard].append(r.place)
        by_slot[r.virtual_slot].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(s) == 1 for s in by_slot.values())
    assert max(load.values()) - min(load.get(k, 0) for k in range(8)) <= max(r["size"] for r in rows)


def test_deterministic(odd):
    columns = "doc_id", "size", "text_crc32", "shard", "place"
    assert rows_of(sharding.assign(odd, 5), *columns) == rows_of(sharding.assign(odd.repartition(7), 5), *columns)


def test_empty(empty):
    assert sharding.assign(empty, 8).collect() == []


def test_repeats_spread(spark):
    rows = sharding.assign(spark.createDataFrame([(1, "same")] * 4000 + [(None, None)] * 4000, "doc_id long, text string"), 8).collect()
    load = Counter(r.shard for r in rows)
    assert len(rows) == 8000 and len(load) == 8 and max(load.values()) < 1.2 * min(load.values())


def test_map_is_edited(spark, odd, tmp_path):
    """Two rebalances and a growth on one stored map: each call starts at the last version."""
    path, versions = str(tmp_path / "map"), sharding.SlotMap(spark, str(tmp_path / "map"), 64)
    shard_of = lambda v: {r.slot: r.shard for r in versions.read(v).collect()}
    sharding.assign(odd, 4, slots=64, map_path=path)
    assert versions.last() == 1 and shard_of(0) == {s: s % 4 for s in range(64)}
    more = odd.union(odd.filter("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 5000))
    rows = sharding.assign(more, 4, slots=64, map_path=path).collect()
    assert versions.last() == 2 and {r.version for r in rows} == {2}
    sums = {r.slot: r.bytes for r in versions.read(2).collect()}
    assert shard_of(2) == sharding.rebalanced(shard_of(1), sums, 4) and all(shard_of(2)[r.virtual_slot] == r.shard for r in rows)
    rows = sharding.assign(more, 5, slots=64, map_path=path).collect()
    assert versions.last() == 3 and shard_of(3) == sharding.rebalanced(sharding.grown(shard_of(2), sums, 4), sums, 5)
    assert set(shard_of(3).values()) == set(range(5)) and all(shard_of(3)[r.virtual_slot] == r.shard for r in rows)
    with pytest.raises(ValueError, match="fewer"):
        sharding.assign(more, 3, slots=64, map_path=path)
    with pytest.raises(ValueError, match="slots"):
        sharding.SlotMap(spark, path, 32).edited(5, {})


def test_copies_in_steps(spark, monkeypatch):
    rows = [(1, "same")] * 50 + [(2, "other")] * 7 + [(None, None)] * 23
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = rows_of(sharding.slotted(docs), "doc_id", "copy", "virtual_slot")
    monkeypatch.setattr(sharding, "COPIES", 7)
    assert rows_of(sharding.slotted(docs), "doc_id", "copy", "virtual_slot") == whole and len(whole) == 80


def test_growth_moves_only_into_the_new_shard():
    sizes = {s: (s * 7919) % 997 + 1 for s in range(512)}
    held = sharding.rebalanced({s: s % 8 for s in range(512)}, sizes, 8)
    more = sharding.grown(held, sizes, 8)
    assert all(more[s] in (held[s], 8) for s in held)
    load = Counter()
    for s, shard in more.items():
        load[shard] += sizes[s]
    assert max(load.values()) < 1.05 * min(load.values())

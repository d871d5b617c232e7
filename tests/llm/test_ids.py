"""Ids that aren't numbers: every operator but the record files takes them as they are."""

import numpy as np
import pytest
from conftest_llm import rows_of
from quarry.llm import bpe, exact_dedup, licenses, quality, sharding, toxicity, wordpiece

ROWS = [("k-1", "Some words.\nReleased under the MIT License"), ("k-1", "again"), (None, None), ("z", ""), ("é", "SOME words.\nreleased under the mit license")]


@pytest.fixture(scope="module", params=["string", "struct<a:string,b:int>", "decimal(20,3)"])
def docs(request, spark):
    made = {"string": lambda k: k, "struct<a:string,b:int>": lambda k: (k, 1), "decimal(20,3)": lambda k: __import__("decimal").Decimal(len(k)) / 4}[request.param]
    return spark.createDataFrame([(None if k is None else made(k), t) for k, t in ROWS], f"name {request.param}, text string")


@pytest.mark.parametrize("of", [bpe.round_trip, bpe.encode, wordpiece.count, licenses.scan, lambda d, id_col: toxicity.score(d, toxicity.constant(0.0), id_col), lambda d, id_col: quality.score(d, quality.Model(), id_col), exact_dedup.groups])
def test_ids_pass(docs, of):
    got = of(docs, id_col="name")
    assert got.schema["id"].dataType == docs.schema["name"].dataType
    assert rows_of(got, "id") == rows_of(docs.withColumnRenamed("name", "id"), "id")


def test_found(docs):
    blocks = licenses.blocks(docs, id_col="name").collect()
    assert len(blocks) == 2 and {b.label for b in blocks} == {"mit"}
    assert exact_dedup.deduplicate(docs, "name").count() == 3
    rows = sharding.assign(docs, 2, "name").collect()
    assert len(rows) == 5 and sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in ROWS)
    assert [len(r.decoded) for r in bpe.decode(bpe.encode(docs, "name")).collect()] == [len(np.frombuffer((t or "").encode(), np.uint8)) for _, t in ROWS]

import hashlib
import importlib.util

import pytest
import tiktoken
from conftest_llm import words
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not there", allow_module_level=True)

import corpus_pipeline
from quarry.llm import bpe, toxicity
from test_contamination import brute as leaks
from test_near_dup import brute as classes


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, labels, F.lit(True))
    one = model.scorer()
    rows = [(i, t) for i, t in rows if one(t or "") < 0.3]
    last = {}
    for i, t in rows:
        key = (t or "").encode().lower()
        last[key] = max(i, last.get(key, i))
    rows = [(i, t) for i, t in rows if last[(t or "").encode().lower()] == i]
    first = {i for i, c, _ in classes(rows)[0] if i == c}
    rows = [(i, t) for i, t in rows if i in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _, _ in leaks(rows, items) if not hit}
    rows = [(i, t) for i, t in rows if i in clean]
    ranks = bpe.Codec(bpe.default_path()).rank
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = {(i, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert len(want) < docs.count() and all(words(t) is not None for _, t in rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_on_nothing(spark, sf_dir):
    from quarry.llm.common import written

    docs = written(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), "none")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_stages_on_odd_texts(spark, sf_dir, odd):
    """Nulls, repeats, ties and other columns pass through every stage, one behind the other."""
    from quarry.llm.common import written

    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == odd.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert 0 < last.count() == docs.count() < odd.count()

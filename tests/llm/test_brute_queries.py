"""The queries that SQL can't express, as they are registered, against plain loops over the tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import tiktoken
from quarry.llm import bpe, quality, queries, wordpiece
from test_classifiers import naive_quality, naive_toxicity
from test_records import ids_of
from test_wordpiece import Library


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").collect()


def remainder(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_op1(spark, sf_dir, texts):
    rows = queries.op1_virtual_slots(spark, sf_dir).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()} and len(rows) == len(texts)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8 for r in rows)
    load, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shards[r.virtual_slot].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    largest = max(sum(r["size"] for r in rows if r.virtual_slot == v) for v in shards)
    assert max(load.values()) - min(load.values()) <= largest


def test_op2(spark, sf_dir, texts):
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.Codec(bpe.default_path()).rank, special_tokens={})
    want = set()
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    rows = queries.op2_matrix_bpe(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)


def test_op4(spark, sf_dir, texts, labels):
    """Against n-grams themselves; some of these share a place in the query's hash."""
    known = [r for r in labels if remainder(r.doc_id, 4) != 2 and r.toxic in (0, 1)]
    size = Counter(r.toxic for r in known)
    learnt = [r for r in known if r.doc_id in texts]
    got = Counter(r.toxic for r in learnt)
    order = list(texts)
    scores, _ = naive_toxicity([texts[r.doc_id] for r in learnt], [r.toxic for r in learnt], [size[r.toxic] / got[r.toxic] for r in learnt], [texts[i] for i in order])
    rows = {r.doc_id: r for r in queries.op4_nb_ngrams(spark, sf_dir).collect()}
    assert set(rows) == set(texts) and all(r.held_out == (remainder(i, 4) == 2) and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    assert max(abs(rows[i].score - s) for i, s in zip(order, scores, strict=True)) < 0.02


def test_op5(spark, sf_dir, texts, labels, monkeypatch):
    for name, value in (("ROUNDS", 2), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 8), ("COARSE", 3)):
        monkeypatch.setattr(quality, name, value)
    known = [r for r in labels if remainder(r.doc_id, 3) != 1 and r.quality in (0, 1)]
    size, learnt = Counter(r.quality for r in known), sorted((r for r in known if r.doc_id in texts), key=lambda r: r.doc_id)
    got = Counter(r.quality for r in learnt)
    of = {i: quality.numbers(t) for i, t in texts.items()}
    order = list(texts)
    scores, *_ = naive_quality(np.array([of[r.doc_id] for r in learnt]), np.array([float(r.quality) for r in learnt]), np.array([size[r.quality] / got[r.quality] for r in learnt]), np.array([of[i] for i in order]))
    rows = {r.doc_id: r for r in queries.op5_pairwise_gam(spark, sf_dir).collect()}
    assert set(rows) == set(texts) and all(r.held_out == (remainder(i, 3) == 1) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    assert max(abs(rows[i].score - s) for i, s in zip(order, scores, strict=True)) < 1e-6


def test_op8(spark, sf_dir, texts):
    want, at = set(), 0
    for i in sorted(texts):
        ids = ids_of(texts[i])
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = queries.op8_record_files(spark, sf_dir).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_op9(spark, sf_dir, texts):
    model, want = Library(*wordpiece.pieces_of(wordpiece.default_path())), set()
    known = {}
    for i, t in texts.items():
        own = regex.findall(wordpiece.WORD, t)
        for w in own:
            if w not in known:
                known[w] = model(w.encode())
        want.add((i, len(own), sum(known[w][0] for w in own), sum(known[w][1] for w in own)))
    rows = queries.op9_piece_counts(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in rows} == want and len(rows) == len(want)

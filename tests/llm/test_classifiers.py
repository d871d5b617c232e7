import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import odd_texts, rows_of
from pyspark.sql import functions as F
from quarry.llm import quality, toxicity
from quarry.llm.queries import op4_nb_ngrams, op5_pairwise_gam

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split()
INSULTS = ["glurbid", "snorvex", "drattle"]


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of which a fifth hold an insult, with endings that training need not have seen."""
    rng, rows = random.Random(8), []
    for k in range(900):
        own = [word(rng) for _ in range(rng.randint(5, 200))]
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), rng.choice(INSULTS) + rng.choice(["", "s", "ly", "ing", word(rng)]))
        text = " ".join(own) + "."
        good = int(k % 4 != 1)
        rows.append((k, text if good else " | ".join(own) + " ###" * 9, toxic, good))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").repartition(3).cache()


def held_out(scores, corpus, label, cut):
    rows = scores.join(corpus.select(F.col("doc_id").alias("id"), label), "id").filter(toxicity.remainder(F.col("id"), 4) == 2).collect()
    got = np.array([r.score >= cut for r in rows])
    want = np.array([bool(r[label]) for r in rows])
    return got, want


def test_toxicity(corpus):
    labels = corpus.select("doc_id", "toxic")
    model = toxicity.train(corpus, labels, toxicity.remainder(F.col("doc_id"), 4) != 2)
    got, want = held_out(toxicity.score(corpus, model), corpus, "toxic", 0.3)
    assert (got & want).sum() >= 0.9 * want.sum() and (got & ~want).sum() <= 0.03 * (~want).sum()
    left = toxicity.drop_toxic(corpus, model)
    assert left.columns == corpus.columns and left.count() == toxicity.score(corpus, model).filter("score < 0.3").count()


def test_quality(corpus):
    labels = corpus.select("doc_id", "quality")
    model = quality.train(corpus, labels, toxicity.remainder(F.col("doc_id"), 4) != 2)
    got, want = held_out(quality.score(corpus, model), corpus, "quality", 0.5)
    assert (got == want).mean() > 0.95


def test_interactions_are_found():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000], np.ones(3000))
    assert (model.pairs[0][0], model.pairs[0][1]) == (2, 5)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_odd_texts(corpus, odd, empty):
    learn = F.lit(True)
    toxic = toxicity.train(corpus, corpus.select("doc_id", "toxic"), learn)
    good = quality.train(corpus, corpus.select("doc_id", "quality"), learn)
    for scores in (toxicity.score(odd, toxic), quality.score(odd, good)):
        rows = scores.collect()
        assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, toxic).collect() == [] and quality.score(empty, good).collect() == []
    assert toxicity.drop_toxic(odd, toxic).columns == odd.columns


@pytest.mark.parametrize("values", [[], [None], [1, 1], [0]])
def test_labels_of_one_class(spark, corpus, values):
    labels = spark.createDataFrame([(k, v, v) for k, v in enumerate(values)], "doc_id long, toxic int, quality int")
    share = float(bool(values and values[0]))
    for kind, column in ((toxicity, "toxic"), (quality, "quality")):
        model = kind.train(corpus, labels, F.lit(True), column)
        assert all(round(r.score, 6) == share for r in kind.score(corpus.limit(5), model).collect())


def test_places_are_distinct():
    grams = toxicity.NGrams()
    for text in ("", "a", "abcabcabc" * 50, "Ünï cödé 漢字 👍", "a" * 100):
        got = grams.places(text)
        assert len(got) == len(set(got.tolist()))
        low = text.lower()
        assert len(got) <= sum(len({low[k : k + n] for k in range(len(low) - n + 1)}) for n in toxicity.ORDERS)
    assert set(grams.places("Idiot").tolist()) == set(grams.places("idiot").tolist())


def test_long_texts_in_parts(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefg ", k=5000))
    whole = sorted(toxicity.NGrams().places(text).tolist())
    monkeypatch.setattr(toxicity, "PART", 100)
    assert sorted(toxicity.NGrams().places(text).tolist()) == whole
    many = "one one two\nthree three  three\t" * 50
    numbers = quality.numbers(many)
    monkeypatch.setattr(quality, "PART", 7)
    assert quality.numbers(many) == numbers


@pytest.mark.parametrize(("query", "of", "out", "cut"), [(op4_nb_ngrams, 4, 2, 0.3), (op5_pairwise_gam, 3, 1, 0.5)])
def test_queries(spark, sf_dir, query, of, out, cut):
    rows = query(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == out) and r.predicted == int(r.score >= cut)


def test_scores_depend_on_texts_alone(spark, corpus):
    model = toxicity.train(corpus, corpus.select("doc_id", "toxic"), F.lit(True))
    other = corpus.withColumn("doc_id", -F.col("doc_id"))
    assert sorted(s for _, s in rows_of(toxicity.score(other, model), "id", "score")) == sorted(s for _, s in rows_of(toxicity.score(corpus, model), "id", "score"))


def grams_of(text):
    low = text.lower()
    return {low[k : k + n] for n in toxicity.ORDERS for k in range(len(low) - n + 1)}


def naive_toxicity(texts, labels, weights, every):
    """The scores of the texts `every` by the model over n-grams themselves, in dictionaries and loops,
    and the number of n-grams it keeps."""
    grams = [grams_of(t) for t in texts]
    count = [Counter(), Counter()]
    for own, y in zip(grams, labels, strict=True):
        count[y].update(own)
    known = sorted(set().union(*grams))
    n = [labels.count(0), labels.count(1)]
    ratio, strength = {}, {}
    for g in known:
        has = [count[k][g] for k in (0, 1)]
        q, p = ((has[k] + toxicity.SMOOTH) / (n[k] + 2 * toxicity.SMOOTH) for k in (0, 1))
        both = (sum(has) + toxicity.SMOOTH) / (sum(n) + 2 * toxicity.SMOOTH)
        if abs(p - q) >= toxicity.SURE * (both * (1 - both) * (1 / n[0] + 1 / n[1])) ** 0.5:
            ratio[g], strength[g] = np.log(p / q), abs(np.log(p / q) * (p - q))
    kept = sorted(ratio, key=lambda g: -strength[g])[: toxicity.FEATURES]
    total = sum(weights)
    share = sum(w * y for w, y in zip(weights, labels, strict=True)) / total
    beta, b0 = dict.fromkeys(kept, 0.0), float(np.log(share / (1 - share)))
    m, v = dict.fromkeys([*kept, None], 0.0), dict.fromkeys([*kept, None], 0.0)
    score = lambda own: 1 / (1 + np.exp(-(b0 + sum(ratio[g] * beta[g] for g in kept if g in own))))
    held = [[g for g in kept if g in own] for own in grams]
    for step in range(1, toxicity.STEPS + 1):
        errors = [w / total * (1 / (1 + np.exp(-(b0 + sum(ratio[g] * beta[g] for g in own)))) - y) for own, y, w in zip(held, labels, weights, strict=True)]
        slope = {g: toxicity.PENALTY * beta[g] for g in kept}
        for own, e in zip(held, errors, strict=True):
            for g in own:
                slope[g] += e * ratio[g]
        slope[None] = sum(errors)
        move = {}
        for g, d in slope.items():
            m[g], v[g] = 0.9 * m[g] + 0.1 * d, 0.999 * v[g] + 0.001 * d * d
            move[g] = 0.05 * (m[g] / (1 - 0.9**step)) / (np.sqrt(v[g] / (1 - 0.999**step)) + 1e-9)
        b0 -= move.pop(None)
        beta = {g: beta[g] - move[g] for g in kept}
    return [score(grams_of(t)) for t in every], len(kept)


def test_toxicity_against_a_naive_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "SURE", 1.5)
    rng = random.Random(5)
    texts, labels = [], []
    for k in range(24):
        texts.append(" ".join([word(rng) for _ in range(6)] + [rng.choice(INSULTS).title()] * (k % 3 == 0)))
        labels.append(int(k % 3 == 0) ^ (k == 7))
    weights = [1.0 + 0.5 * y for y in labels]
    grams = toxicity.NGrams()
    places = [set(grams.places(t).tolist()) for t in texts]
    exact = [grams_of(t) for t in texts]
    assert len(set().union(*places)) == len(set().union(*exact))  # no two share a place
    want, kept = naive_toxicity(texts, labels, weights, texts)
    model = toxicity.fit(texts, np.array(labels), np.array(weights))
    assert len(model.places) == kept > 20
    assert np.allclose([model.scorer()(t) for t in texts], want, atol=1e-4)


def naive_tree(x, g, h, bins):
    """A value a bin: the best split of all bins, then the best of either side, by trying each."""
    total = lambda a, b: (sum(gi for xi, gi in zip(x, g, strict=True) if a <= xi < b), sum(hi for xi, hi in zip(x, h, strict=True) if a <= xi < b))

    def split(a, b):
        best, at = 0.0, None
        for c in range(a + 1, b):
            (lg, lh), (rg, rh), (tg, th) = total(a, c), total(c, b), total(a, b)
            gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - tg**2 / (th + 1)
            if min(lh, rh) >= quality.LEAST and gain > best + 1e-12:
                best, at = gain, c
        return at

    cuts = [0, bins]
    if (at := split(0, bins)) is not None:
        cuts = [0, *[c for c in (split(0, at), at, split(at, bins)) if c is not None], bins]
    out = [0.0] * bins
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        tg, th = total(a, b)
        out[a:b] = [-tg / (th + 1)] * (b - a)
    return out


def naive_quadrants(x, y, g, h, shape):
    """The best table of a split of x and one of y on either side of it, by trying each."""
    best, gain = [[0.0] * shape[1] for _ in range(shape[0])], 0.0
    for first in range(1, shape[0]):
        table, got = [[0.0] * shape[1] for _ in range(shape[0])], 0.0
        for a, b in ((0, first), (first, shape[0])):
            own, value = (-1.0, None), lambda tg, th: tg / (th + 1) if th >= quality.LEAST else 0.0
            for c in range(1, shape[1]):
                sides = [(sum(gi for xi, yi, gi in zip(x, y, g, strict=True) if a <= xi < b and (yi < c) == low), sum(hi for xi, yi, hi in zip(x, y, h, strict=True) if a <= xi < b and (yi < c) == low)) for low in (True, False)]
                here = sum(value(*s) * s[0] for s in sides)
                if here > own[0] + 1e-12:
                    own = here, (c, [-value(*s) for s in sides])
            got += own[0]
            c, (left, right) = own[1]
            for i in range(a, b):
                table[i] = [left] * c + [right] * (shape[1] - c)
        if got > gain + 1e-12:
            best, gain = table, got
    return best, gain


def naive_quality(x, y, w, every):
    """Boosting by loops over rows, by the constants of the module: the scores of the rows `every`, the
    features' tables and the pairs' tables."""
    w = w * (len(y) / w.sum())
    share = float((w * y).sum() / w.sum())
    place = lambda rows, n: [[int(sum(v >= e for e in np.unique(np.quantile(x[:, k], np.arange(1, n) / n)))) for v in rows[:, k]] for k in range(x.shape[1])]
    size = lambda n: [len(np.unique(np.quantile(x[:, k], np.arange(1, n) / n))) + 1 for k in range(x.shape[1])]
    bins, rough, wide, shape = place(x, quality.BINS), place(x, quality.COARSE), size(quality.BINS), size(quality.COARSE)
    own, own_rough = place(every, quality.BINS), place(every, quality.COARSE)
    z, out = [float(np.log(share / (1 - share)))] * len(y), [float(np.log(share / (1 - share)))] * len(every)
    slopes = lambda: zip(*[(wi * (1 / (1 + np.exp(-zi)) - yi), wi * (1 / (1 + np.exp(-zi))) * (1 - 1 / (1 + np.exp(-zi)))) for wi, yi, zi in zip(w, y, z, strict=True)], strict=True)
    clip = lambda v: quality.RATE * max(-4.0, min(4.0, v))
    tables = [[0.0] * n for n in wide]
    for _ in range(quality.ROUNDS):
        for k in range(len(wide)):
            step = [clip(v) for v in naive_tree(bins[k], *slopes(), wide[k])]
            tables[k] = [a + b for a, b in zip(tables[k], step, strict=True)]
            z = [a + step[b] for a, b in zip(z, bins[k], strict=True)]
    able = [k for k, n in enumerate(shape) if n > 1]
    gains = {(a, b): naive_quadrants(rough[a], rough[b], *slopes(), (shape[a], shape[b]))[1] for a in able for b in able if a < b}
    chosen = sorted(gains, key=lambda ab: (-gains[ab], ab))[: quality.PAIRS]
    pairs = {(a, b): np.zeros((shape[a], shape[b])) for a, b in chosen}
    for _ in range(quality.PAIR_ROUNDS):
        for a, b in chosen:
            step = [[clip(v) for v in row] for row in naive_quadrants(rough[a], rough[b], *slopes(), (shape[a], shape[b]))[0]]
            pairs[a, b] += step
            z = [v + step[i][j] for v, i, j in zip(z, rough[a], rough[b], strict=True)]
    for k, table in enumerate(tables):
        out = [v + table[i] for v, i in zip(out, own[k], strict=True)]
    for (a, b), table in pairs.items():
        out = [v + table[i][j] for v, i, j in zip(out, own_rough[a], own_rough[b], strict=True)]
    return 1 / (1 + np.exp(-np.array(out))), tables, pairs


def test_quality_against_naive_boosting(monkeypatch):
    for name, value in (("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2), ("BINS", 6), ("COARSE", 4), ("LEAST", 0.5)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    w = 1 + rng.random(80)
    model = quality.fit(x, y, w)
    more = rng.normal(size=(30, 3))
    scores, tables, pairs = naive_quality(x, y, w, more)
    assert np.allclose(model.tables, tables)
    assert [(a, b) for a, b, _ in model.pairs] == list(pairs) and all(np.allclose(t, pairs[a, b]) for a, b, t in model.pairs)
    assert np.allclose(model.score(more), scores)


def test_sample_is_bounded_in_characters(corpus, monkeypatch):
    """Too few characters for a feature to be sure of: the score is the share of what was drawn."""
    labels = corpus.select("doc_id", "toxic")
    assert len(toxicity.train(corpus, labels, F.lit(True)).places) > 0
    monkeypatch.setattr(toxicity, "MOST_CHARS", 3000)
    assert len(toxicity.train(corpus, labels, F.lit(True)).places) == 0


def test_kept_columns(spark):
    docs = spark.createDataFrame([("a", "some text", 5, "x")], "key string, body string, text int, `odd name` string")
    model = toxicity.constant(1.0)
    row = toxicity.score(docs, model, "key", "body", "text").first()
    assert (row.id, row.text) == ("a", 5) and row.score > 0.99
    assert quality.described(docs, "key", "body", "text").first().text == 5
    for own in (toxicity.score, quality.score):
        with pytest.raises(ValueError, match="named"):
            own(docs.withColumn("score", F.lit(1)), model, "key", "body", "score")

import random
import re

import pytest
from conftest_llm import odd_texts, rows_of, words
from quarry.llm import common, licenses

PUNCTUATION = [" ", "  ", ", ", "-", ". "]


def brute(text):
    own, found = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        found += [(k, label) for k in range(len(own)) if own[k : k + len(p)] == p]
    labels, best = {x for _, x in found}, 0.0
    lines = [words(line) for line in (text or "").split("\n")]
    of = [k for k, line in enumerate(lines) for _ in line]  # the line of each word
    for label, notice in licenses.TEMPLATES:
        t, n = set(words(notice)), len(words(notice))
        share = [len(t & set(line)) / len(t) for line in lines]
        hits = {k for k, c in enumerate(share) if c >= licenses.THRESHOLD - 1e-12}
        runs = [range(s, min(s + n, len(own))) for s in range(max(1, len(own) - n + 1)) if own]
        share += [len(t & {own[k] for k in r}) / len(t) for r in runs if of[r[0]] < of[r[-1]] and not hits & set(range(of[r[0]], of[r[-1]] + 1))]
        if max(share) >= licenses.THRESHOLD - 1e-12:
            labels.add(label)
            best = max(best, max(share))
    at = [k for k, _ in found]
    join = lambda x: ",".join(sorted(x))
    return len(own), len(found), min(at, default=None), max(at, default=None), join({x for _, x in found}), join(labels), 1.0 if found else best


COLUMNS = "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"


def test_scan(odd, empty):
    got = rows_of(licenses.scan(odd), "id", *COLUMNS)
    assert got == sorted(((i, *brute(t)) for i, t in odd_texts()), key=repr)
    assert any("apache" in r[6] for r in got) and any("mit" in r[6] for r in got)
    assert licenses.scan(empty).collect() == [] and licenses.blocks(empty).collect() == []


@pytest.fixture(scope="module")
def mangled():
    """Notices with words left out, doubled, moved and put in, and lines broken anywhere."""
    rng, out = random.Random(3), []
    for k in range(600):
        own = re.findall(r"\S+", rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.randrange(4)):
            own.pop(rng.randrange(len(own))) if rng.random() < 0.6 and len(own) > 1 else own.insert(rng.randrange(len(own)), rng.choice(["the", "of", "license", "und", "mit", "gnu"]))
        if rng.random() < 0.3:
            rng.shuffle(own)
        if rng.random() < 0.3:
            own += re.findall(r"\S+", rng.choice(licenses.TEMPLATES)[1])
        gaps = PUNCTUATION if k % 2 else [*PUNCTUATION, "\n", "\n // "]
        body = "".join(w + rng.choice(gaps) for w in own)
        out.append((k, rng.choice(["first line\n", "", "\n\n", "the "]) + body + rng.choice(["\nlast", "", "\n"])))
    return out


def test_join_is_exact(spark, mangled):
    df = spark.createDataFrame(mangled, "doc_id long, text string")
    assert rows_of(licenses.scan(df), "id", *COLUMNS) == sorted(((i, *brute(t)) for i, t in mangled), key=repr)
    some = licenses.blocks(df).collect()
    text = dict(mangled)
    assert some and all(set(words(text[r.id].encode()[r.begin : r.end].decode())) for r in some)


def test_long_line(monkeypatch):
    monkeypatch.setattr(common, "PART", 64)
    low = b"filler words " * 100 + b"released under the mit license " + b"more " * 100
    assert [w for part in common.byte_words(low) for w in part] == words(low.decode())
    found = licenses.Join({}).blocks(low, licenses.is_word())
    assert [licenses.TEMPLATES[k][0] for _, _, k, _ in found] == ["mit"]

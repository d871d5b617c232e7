import random
import re

import pytest

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, id long, row long, words string, n int, `set` string, score double, __row long, item string, version int"


def words(text):
    """The words of a text by the rule of the contracts, as bytes."""
    return WORD.findall((text or "").encode().lower())


def odd_texts():
    """(doc_id, text) with nulls, empty and long texts, ties, repeats and near copies."""
    rng = random.Random(11)
    vocabulary = ["the", "of", "river", "stone", "Über", "naïve", "cc", "by", "x1", "Ça", "moon", "garden", "2024", "don't", "WALK", "été", "İstanbul", "Σίσυφος"]
    base = [" ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    rows = list(enumerate(base))
    rows += [(100 + k, t.upper() if k % 2 else t) for k, t in enumerate(base[:4])]  # equal but for case, or exactly
    rows += [(200 + k, t.replace(t.split()[30], "changed", 1)) for k, t in enumerate(base[:6])]  # near
    rows += [(300 + k, t.replace(t.split()[k], f"edit{k}", 1)) for t in base[:1] for k in range(2, 50)]  # a group of near copies
    rows += [(None, base[0]), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "."), (5, "one two"), (6, "one two"), (6, "one two"), (7, "One TWO"), (8, "é")]
    rows += [(400, "a" * 30_000), (401, " ".join(base * 30)), (402, " ".join(base * 30)), (403, "word " * 5000), (404, "\n" * 1000), (405, "ÀÉ" * 3000), (406, "x\x00y \x1c z"), (407, "日本語 テキスト 👍 naïve")]
    rows += [(500, "Some text here.\nLicensed under the Apache License, Version 2.0.\nMore"), (501, "cc by-nc\nReleased under the  MIT  License"), (502, "All rights\nreserved. ALL RIGHTS RESERVED"), (503, "general public licenses and general public license"), (504, "cc by cc by cc"), (505, "the the of river cc. by")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts as a table with other columns whose names the operators use inside."""
    return frame(spark, odd_texts())


def frame(spark, rows):
    from quarry.llm.common import written

    full = [(i, t, None, 1, 2, "w", 3, "s", 0.5, 9, "i", 1) for i, t in rows]
    return written(spark.createDataFrame(full, SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


def rows_of(df, *columns):
    """The rows as sorted tuples of these columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

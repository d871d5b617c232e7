"""Scans of one table whose files are dealt to other partitions than in the scan before, as when
executors come or go: a row's place differs, so rows must be matched by content."""

import pytest
from conftest_llm import odd_texts, rows_of
from quarry.llm import common, contamination, exact_dedup, near_dup
from test_contamination import brute as leaks
from test_exact_dedup import brute as equal
from test_exact_dedup import normal
from test_near_dup import brute as near


@pytest.fixture
def dealt_anew(spark, odd, monkeypatch):
    """The odd texts, whose files are dealt to one partition until an operator's first table is
    written, and to one each after that."""
    name, written = "spark.sql.files.minPartitionNum", common.written

    def then(df, at, **how):
        out = written(df, at, **how)
        spark.conf.set(name, "64")
        return out

    for module in (common, contamination, exact_dedup, near_dup):
        monkeypatch.setattr(module, "written", then)
    parts = []
    for n in ("64", "1"):
        spark.conf.set(name, n)
        parts.append(odd.select("text").rdd.getNumPartitions())
    assert parts == [3, 1]
    yield odd
    spark.conf.unset(name)


def test_near_copies(dealt_anew):
    assert rows_of(near_dup.join(dealt_anew), "id", "class_id", "n_links") == near(odd_texts())[0]


def test_a_row_of_each_class(dealt_anew):
    """Also where rows repeat id and text."""
    left = [(r.doc_id, r.text) for r in near_dup.deduplicate(dealt_anew).collect()]
    assert len(left) == near(odd_texts())[1] == near(left)[1]


def test_a_row_of_each_text(dealt_anew):
    left = [(r.doc_id, normal(r.text)) for r in exact_dedup.deduplicate(dealt_anew).collect()]
    assert sorted(left, key=repr) == sorted(((i, k) for k, i in equal(odd_texts())[1].items()), key=repr)


def test_clean_rows(spark, dealt_anew):
    items = [(1, " ".join(odd_texts()[2][1].split()[5:30])), (2, "one two")]
    out = contamination.decontaminate(dealt_anew, spark.createDataFrame(items, "item_id long, text string"))
    want = [r for r in odd_texts() if not leaks([r], items)[0][2]]
    assert rows_of(out, "doc_id", "text") == sorted(want, key=repr)

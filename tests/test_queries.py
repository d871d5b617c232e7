import pytest

import __spark_entry__ as entry
from quarry.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, agree, name):
    agree(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])


def test_entry(spark):
    found = entry.entry(spark)
    assert {"path", "split", "n", "balance", "strict"} == set(found.columns)
    rows = found.collect()
    assert rows and all(r.strict and r.balance == 1.0 for r in rows)


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())

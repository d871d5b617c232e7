from array import array
from itertools import batched

import duckdb

from quarry.plans import registry


def test_products_that_round_to_whole_numbers(spark, tmp_path):
    """Each thousandth as a float: the SQL's product of floats is that whole number where one of doubles can lie just below it."""
    thousandths = [(-1) ** k * x for k, x in enumerate(array("f", [k / 1000 for k in range(1024)]))]
    rows = [(i, list(v), i % 10) for i, v in enumerate(batched(thousandths, 2))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["sample_balance"]).fetchall())
    assert len(want) == 512 and any(strict for *_, strict in want)
    assert sorted(map(tuple, registry.sample_balance(spark, str(tmp_path)).collect())) == want

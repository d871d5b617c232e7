import pytest
from pyspark.sql import functions as F
from quarry.operators import acquire


def test_no_level_is_left_out_silently(spark):
    """Four levels, each with a file and, but for the last, a folder."""
    roots = spark.createDataFrame([("a__b", "0")], "slug string, url string")

    def lister(level):
        kinds = level.select("slug", F.explode(F.array(F.lit("file"), F.lit("dir"))).alias("type"), (F.col("url").cast("int") + 1).alias("n"))
        return kinds.filter("type = 'file' or n < 4").select("slug", "type", F.col("n").cast("string").alias("url"))

    files = acquire.expand(roots, lister)
    assert sorted((r.depth, r.url) for r in files.collect()) == [(0, "1"), (1, "2"), (2, "3"), (3, "4")]
    assert acquire.expand(roots, lister, max_depth=4).count() == 4
    with pytest.raises(RuntimeError, match="left"):
        acquire.expand(roots, lister, max_depth=2)


def test_a_deep_chain(spark):
    """A hundred and twenty folders, one in the other, with a file in each."""
    roots = spark.createDataFrame([("a__b", "0")], "slug string, url string")

    def lister(level):
        kinds = level.select("slug", F.explode(F.array(F.lit("file"), F.lit("dir"))).alias("type"), (F.col("url").cast("int") + 1).alias("n"))
        return kinds.filter("type = 'file' or n < 120").select("slug", "type", F.col("n").cast("string").alias("url"))

    assert sorted(r.depth for r in acquire.expand(roots, lister).select("depth").collect()) == list(range(120))

"""Sources to packed training data: scan, tokenize, encode, split, pack, write."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.shared import settings as session
from quarry.functions.shared import written
from quarry.operators import metrics, pack, tokenize
from quarry.sources import files
from quarry.sources.config import Prepare, parsed


@dataclass
class Prepared:
    pack: Callable[[], DataFrame]
    quarantine: DataFrame  # path, error
    totals: DataFrame  # split, files, tokens

    @functools.cached_property
    def packed(self) -> DataFrame:
        """path, split, start, n, ids; laid end to end when first asked for."""
        return self.pack()


def packed(sources: DataFrame, val_frac: float = 0.05, seed: int = 0, path: str = "path", content: str = "content") -> Prepared:
    """The packed streams of sources. Ids are made once, as a written table that the
    accepted and the refused files both come from."""
    found = tokenize.tokenized_ids(sources.select(F.col(path).alias("path"), F.col(content).alias("content")))
    found = written(found.withColumn("n", F.coalesce(F.size("ids"), F.lit(0)).cast("long")), "ids")
    own = tokenize.accepted(found)
    totals = pack.totals(own.select("n", text.split(F.col("path"), val_frac, seed).alias("split")))
    return Prepared(lambda: pack.shuffled_offsets(own, "path", "n", val_frac, seed), tokenize.quarantine(found).select("path", "error"), totals)


def run(spark: SparkSession, settings: Prepare) -> Prepared:
    """The whole plan: reads settings.src, and below settings.dst writes the packed table by split,
    the raw numbers of each split and the refused files."""
    with session(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(settings.batch)}):
        found = packed(tokenize.spread(files.go_files(spark, settings.src, settings.max_file_bytes)), settings.val_frac, settings.seed)
        if found.totals.isEmpty():
            raise RuntimeError(f"no file below {settings.src} could be tokenized")
        found.packed.write.mode("overwrite").partitionBy("split").parquet(f"{settings.dst}/packed")
        found.quarantine.write.mode("overwrite").parquet(f"{settings.dst}/quarantine")
        stored = spark.read.parquet(f"{settings.dst}/packed")
        for split in ("train", "val"):
            pack.write_bin(stored.filter(F.col("split") == split), f"{settings.dst}/{split}.bin").write.mode("overwrite").parquet(f"{settings.dst}/{split}.parts")
    return Prepared(lambda: stored, found.quarantine, pack.totals(stored))


def balance_by_file(prepared: Prepared) -> DataFrame:
    return metrics.with_balance(prepared.packed).select("path", "split", "n", "balance", "strict")


if __name__ == "__main__":
    found = run(SparkSession.builder.getOrCreate(), parsed(Prepare))
    found.totals.show()

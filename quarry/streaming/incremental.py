"""Incremental ingestion: what a folder of pages or sources brings anew is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import tokenize


def new_names(rows: DataFrame, name: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each name of a stream once to out, over all runs with this checkpoint, which holds
    the names seen; started with what is there now."""
    once = rows.select(F.col(name)).filter(F.coalesce(F.col(name), F.lit("")) != "").dropDuplicates([name])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def go_stream(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the .go files below root as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.go").option("recursiveFileLookup", "true").load(root).select("path", "content")


def tokenized(files: DataFrame, accepted: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Tokenizes a stream of files; each batch goes to two tables, under its number, so that a
    batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        found = tokenize.tokenized(batch).persist()
        tokenize.encoded(tokenize.accepted(found)).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        tokenize.quarantine(found).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        found.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Packing: encoded streams laid end to end, cut into blocks and next-token windows, and written
as raw 16-bit numbers.

Positions come from sums in two steps, over cells and within cells: no window spans the corpus. Rows
are dealt to cells by ranges of their order, as many as a shuffle has partitions, so cells are of like
size whatever the values are. Streams are moved as arrays, cut where blocks begin; no number becomes
a row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.shared import bucketed
from quarry.functions.text import hashed, order_key, split
from quarry.sources.files import file_system


def _summed(df: DataFrame, keys: list[str], order: list[str], length: str, name: str) -> DataFrame:
    """df with the sum of length over the rows up to each, by keys, in this order. Rows that tie are
    dealt by their place in the scan, so that no value needs to fit in one cell. The cells are a
    written table in buckets, so they are summed where they stand."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("__place", F.monotonically_increasing_id())
    own = own.repartitionByRange(n, *keys, *order, "__place").withColumn("__cell", F.spark_partition_id())
    own = bucketed(own, "cells", "__cell", n)
    totals = own.groupBy(*keys, "__cell").agg(F.sum(length).alias("__total"))  # a row a cell and key
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order, "__place").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(F.broadcast(totals), [*keys, "__cell"]).withColumn(name, (F.col("__before") + F.sum(length).over(inside)).cast("long")).drop("__cell", "__before", "__place")


def running_total(df: DataFrame, order: str, length: str, name: str, *ties: str) -> DataFrame:
    """df with the sum of length over the rows up to each, in the order of a column and then of ties;
    rows that tie in all of these follow each other in any order."""
    return _summed(df, [], [order, *ties], length, name)


def shuffled_offsets(files: DataFrame, path: str = "path", length: str = "n", val_frac: float = 0.05, seed: int = 0) -> DataFrame:
    """files with split and start: each split's files laid end to end in shuffled order, that of a
    hash. Files of no length are left out."""
    own = files.filter(F.col(length) > 0).withColumn("split", split(F.col(path), val_frac, seed)).withColumn("__order", order_key(seed, F.col(path)))
    own = _summed(own, ["split"], ["__order", path], length, "__end")
    return own.withColumn("start", F.col("__end") - F.col(length)).drop("__end", "__order")


def batched(files: DataFrame, size: int = 32, path: str = "path", seed: int = 0) -> DataFrame:
    """files with batch: their number in shuffled order, in batches of `size`."""
    own = files.withColumn("__order", order_key(seed, F.col(path))).withColumn("__one", F.lit(1).cast("long"))
    own = _summed(own, [], ["__order", path], "__one", "__at")
    return own.withColumn("batch", F.floor((F.col("__at") - 1) / size)).drop("__order", "__one", "__at")


def _cut(packed: DataFrame, size: int, over: int, keys: tuple[str, ...], ids: str) -> DataFrame:
    """keys, block, ids: the numbers of the streams (start, ids) that stand in each block of `size`
    and the `over` places behind it. A stream is cut into a piece a block; pieces are put together."""
    start, end = F.col("start"), F.col("start") + F.size(ids)

    def piece(block: Column) -> Column:
        begin = F.greatest(start, block * size)
        n = F.least(end, (block + 1) * size + over) - begin
        return F.struct(block.alias("block"), begin.alias("at"), F.slice(ids, (begin - start + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")).alias("piece"))

    first = F.greatest(F.lit(0).cast("long"), F.floor((start - over) / size))
    cut = packed.filter(F.size(ids) > 0).select(*keys, F.explode(F.transform(F.sequence(first, F.floor((end - 1) / size)), piece)).alias("cut"))
    own = cut.select(*keys, "cut.*").groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("own"))  # a block's numbers
    return own.select(*keys, "block", F.flatten(F.transform("own", lambda s: s["piece"])).alias("ids"))


def blocks(packed: DataFrame, size: int, *keys: str, ids: str = "ids") -> DataFrame:
    """keys, block, ids: the streams (start, ids), laid end to end, cut into blocks of `size`, in
    order; the last may have fewer."""
    return _cut(packed, size, 0, keys, ids)


def training_blocks(packed: DataFrame, size: int, *keys: str, ids: str = "ids") -> DataFrame:
    """keys, block, x, y: consecutive blocks of `size` numbers, y one number further on; only whole
    ones. A block's first number is the last of y in the block before, so it goes to both."""
    own = _cut(packed, size, 1, keys, ids).filter(F.size("ids") == size + 1)
    return own.select(*keys, "block", F.slice("ids", 1, size).alias("x"), F.slice("ids", 2, size).alias("y"))


def sampled_windows(packed: DataFrame, size: int, seed: int = 0, count: int | None = None) -> DataFrame:
    """number, start, x, y: windows of `size` numbers at hashed starts, as many as there are whole
    blocks if count is not given. packed: block, ids, as from blocks(). A start is below the number
    of tokens less size + 1, so the last one that would fit is never drawn. Fails when there are too
    few tokens."""
    spark = packed.sparkSession
    total = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
    if total <= size + 1:
        raise ValueError(f"only {total} tokens; more than {size + 1} are needed")
    draws = spark.range(count or max(1, total // size)).select(F.col("id").alias("number"))
    draws = draws.withColumn("start", hashed(seed, F.col("number")) % F.lit(total - size - 1)).withColumn("block", F.floor(F.col("start") / size))
    second = packed.select((F.col("block") - 1).alias("block"), F.col("ids").alias("more"))
    both = draws.join(packed, "block").join(second, "block", "left")
    window = F.slice(F.concat("ids", F.coalesce("more", F.array().cast("array<int>"))), F.col("start") % size + 1, F.lit(size + 1))
    return both.select("number", "start", window.alias("w")).select("number", "start", F.slice("w", 1, size).alias("x"), F.slice("w", 2, size).alias("y"))


# --- raw numbers ---
def write_bin(packed: DataFrame, folder: str, ids: str = "ids") -> DataFrame:
    """Writes the ids of (start, ids) rows of one split as little-endian 16-bit numbers, in order
    of start, to files in folder that are one stream when read in order of their names. Returns part,
    path, n of those whose task committed."""
    own = packed.select("start", F.col(ids).alias("ids"))
    dealt = own.repartitionByRange("start").sortWithinPartitions("start")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = file_system(folder)
        name, n, out = f"part-{context.partitionId():06d}-{context.stageId()}-{context.taskAttemptId()}.bin", 0, None
        for batch in stream:
            numbers = np.asarray(batch.column("ids").flatten())
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            out.write(numbers.astype("<u2").tobytes())
            n += len(numbers)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["part", "path", "n"])

    return dealt.mapInArrow(run, "part int, path string, n long")


def read_bin(parts: DataFrame, size: int) -> DataFrame:
    """block, ids of files written by write_bin, cut anew into blocks of `size`. Files are read as
    streams; fails when they have at most size + 1 numbers."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))  # a row a file
    if (files.agg(F.sum("n")).first()[0] or 0) <= size + 1:
        raise ValueError(f"more than {size + 1} tokens are needed")

    def run(stream: Iterable[pa.RecordBatch]):
        for batch in stream:
            for r in batch.to_pylist():
                fs, path = file_system(r["path"])
                at, rest = r["start"], b""
                with fs.open_input_stream(path) as f:
                    while data := f.read(1 << 20):
                        data = rest + data
                        rest = data[len(data) & ~1 :]
                        numbers = np.frombuffer(data[: len(data) & ~1], "<u2").astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([numbers], pa.list_(pa.int32()))], ["start", "ids"])
                        at += len(numbers)

    return blocks(files.repartition("part").mapInArrow(run, "start long, ids array<int>"), size)


def totals(packed: DataFrame, length: str = "n") -> DataFrame:
    """split, files, tokens."""
    return packed.filter(F.col(length) > 0).groupBy("split").agg(F.count("*").alias("files"), F.sum(length).alias("tokens"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """path, ids of whole headerless files, a row a file; for files that fit in a row."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def numbers(content):
        return content.map(lambda b: np.frombuffer(b, "<u2").astype(np.int32))

    return spark.read.format("binaryFile").load(path).select("path", numbers("content").alias("ids"))

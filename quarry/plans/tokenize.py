"""The tokenizer as a command: paths of Go files as arguments, or - for one a line on the standard
input; one token a line on the standard output, file after file in the order given.

A file that can't be read or parsed gives no token and a line ``skip <path>: <why>`` on the standard
error, and stops no other. Ends with code 2 without arguments, 1 if there were paths and none could be
tokenized, else 0."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import tokenize
from quarry.sources import files


def given(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """place, path of the paths given; trimmed, without blank ones."""
    rows = [(k, p) for k, p in enumerate(x.strip() for x in paths) if p]
    return spark.createDataFrame(rows, "place long, path string")


def found(paths: DataFrame) -> DataFrame:
    """place, path, tokens, error of the files named."""
    read = files.read_paths(tokenize.spread(paths)).withColumnRenamed("error", "unread")
    own = tokenize.tokenized(read, "content")
    return own.withColumn("error", text.excerpt(F.coalesce("unread", "error"))).drop("unread")


def run(spark: SparkSession, args: list[str], stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """The command; rows come to the driver one partition at a time."""
    if not args:
        print("usage: python -m quarry.plans.tokenize FILE... | -", file=err)
        return 2
    paths = given(spark, stdin if args == ["-"] else args)
    some = good = False
    for row in found(paths).orderBy("place").toLocalIterator():
        some = True
        if row.error is None:
            good = True
            print(*row.tokens, sep="\n", file=out)
        else:
            print(f"skip {row.path}: {row.error}", file=err)
    return int(some and not good)


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]) if len(sys.argv) > 1 else run(None, []))

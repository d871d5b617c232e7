"""What the operators share: written tables, word splitting and columns that tell rows apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.shared import bucketed, scope, settings, shared_path, written

__all__ = ["ascii_lower", "bucketed", "byte_words", "dropped", "parquet", "row_key", "scope", "settings", "shared_path", "unused", "without", "words", "written"]

#: Fixed values of the word rule: what parts words, after A-Z were lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BYTE_WORD, BYTE_GAP = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters outside ASCII that lower() may change; \p{Cn} covers those that a newer Unicode assigns.
_OTHER_UPPER = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{IsUppercase}\p{Cn}]]"


def without(docs: DataFrame, placed: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """The rows of placed, which is docs with a column `key`, whose key is not one of out's."""
    return placed.join(out.withColumnRenamed(out.columns[0], key), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def row_key(id_: Column, text: Column) -> Column:
    """16 bytes of SHA-256, never null, that tell rows of different id or text apart. Unlike a row's
    place they are the same in every scan, however its files are dealt to partitions."""
    own = [F.coalesce(F.sha2(c.cast("string"), 256), F.lit("")) for c in (id_, text)]
    return F.substring(F.unhex(F.sha2(F.concat_ws("/", *own), 256)), 1, 16)


def dropped(docs: DataFrame, out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose key out (key, once) has; of those that are to stay once, one
    stays. Rows that repeat id and text are counted before they are moved."""
    out = written(out.distinct(), "dropped")
    key = unused(docs)
    placed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    rest = without(docs, placed, out.select("key"), key)
    once = out.filter("once").select(F.col("key").alias(key))
    if once.isEmpty():
        return rest
    one = placed.join(once, key, "left_semi").dropDuplicates([key])
    return rest.unionByName(one.select(*[f"`{c}`" for c in docs.columns]))


def unused(docs: DataFrame, name: str = "__row") -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty. lower() does that, and fast, for
    all texts but those with upper-case letters outside ASCII, which translate() serves."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(lowered: Column) -> Column:
    """The words of a text whose A-Z are lower-cased, in order."""
    return F.array_remove(F.split(lowered, NOT_WORD), "")


#: Bytes of a text that are cut into words at a time.
PART = 1 << 22


def byte_words(low: bytes) -> Iterator[list[bytes]]:
    """The words of a text whose A-Z are lower-cased, PART bytes at a time."""
    at = 0
    while at < len(low):
        end = re.compile(BYTE_GAP).search(low, at + PART) if at + PART < len(low) else None
        to = end.start() if end else len(low)
        yield re.findall(BYTE_WORD, low[at:to])
        at = to


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

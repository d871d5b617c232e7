"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text, its A-Z lower-cased and null counting as empty, is cut where its content says so, once, and
its chunks are written. Each chunk gets an identifier of 128 bits; a text's recipe is the ordered list
of its chunks' identifiers, and two texts are equal exactly if their recipes are. An identifier
function is accepted only once all distinct chunks of the corpus are shown to have distinct
identifiers, so equality is verified on bytes, yet the one thing that moves between machines is each
distinct chunk, once. What is grouped and joined after that are recipes, some thirtieth of the text.

Defined results: null and empty texts are equal to each other; very long texts are cut and compared
whole, as recipes of many chunks; a null id ranks below any other, and ids may be of any type that
has an order; of rows that tie on id the one read last stays, and of those that tie on text too any
one does; an empty table gives an empty result; other columns of any name are left alone, and pass
through ``deduplicate``. Rows get a number in one scan, which is written; later scans, whose files may
be dealt to other partitions, are matched with it by a key made of id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, dropped, row_key, scope, written

#: A chunk ends, after MIN characters, behind the first place that matches CUT, or at MAX. CUT asks
#: of nine characters in a row whether their code is even (of Latin-1; others count as odd), which
#: one place in some five hundred meets, by its content alone: so chunks settle again behind an edit.
MIN_CHUNK, MAX_CHUNK = 128, 4096
_EVEN = "".join(rf"\x{c:02x}" for c in range(0, 256, 2))
CUT = "".join(f"[{_EVEN}]" if even == "E" else f"[^{_EVEN}]" for even in "EOEEOEOOE")
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<={CUT})|\z)|.{{1,{MAX_CHUNK}}}"

#: Tried in this order until one is verified: half of SHA-256, enough for 1e16 chunks, then all of it.
IDENTIFIERS = (lambda chunk: F.substring(F.unhex(F.sha2(chunk, 256)), 1, 16), lambda chunk: F.unhex(F.sha2(chunk, 256)))


def chunks(lowered: Column) -> Column:
    """The chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(lowered, F.lit(CHUNK), F.lit(0))


def identifier(cut: DataFrame, tried=IDENTIFIERS):
    """The first of the tried functions that gives no two distinct chunks (cut: chunks, an array a
    row) one identifier."""
    own = cut.select(F.explode("chunks").alias("chunk"))
    for of in tried:
        distinct = own.select(of(F.col("chunk")).alias("id"), "chunk").distinct()
        if distinct.groupBy("id").count().filter("count > 1").isEmpty():
            return of
    raise ValueError("two distinct chunks share every identifier tried")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tried=IDENTIFIERS, keyed: bool = False) -> DataFrame:
    """row long, id, text_sha256 string, recipe array, key binary (null unless keyed): one row per
    row of docs, written once."""
    key = row_key(F.col(id_col), F.col(text_col)) if keyed else F.lit(None).cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("lowered"), key.alias("key"))
    with scope(docs.sparkSession):
        cut = written(base.select("row", "id", "key", F.sha2(F.col("lowered"), 256).alias("text_sha256"), chunks(F.col("lowered")).alias("chunks")), "chunks", compression="zstd")
        of = identifier(cut, tried)
        own = cut.select("row", "id", "text_sha256", F.transform("chunks", lambda c: of(c)).alias("recipe"), "key")
        return written(own, "recipes", outer=1)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tried=IDENTIFIERS, keyed: bool = False) -> DataFrame:
    """row, id, keep_id, group_size, kept, text_sha256 of every row of docs; keyed, also key and
    once, whether the row that is kept has the same key.

    Counts and maxima are formed before the shuffle, so a hot group costs a row a task. Only
    groups of two rows and more are joined back; they are written first, so that the join is one
    that Spark can broadcast by size or split where a group is hot."""
    own = recipes(docs, id_col, text_col, tried, keyed)
    shared = own.groupBy("recipe").agg(
        F.max(F.struct("id", "row", "key")).alias("last"), F.count("*").alias("n")
    )
    shared = written(shared.filter("n > 1"), "copies")
    return own.join(shared, "recipe", "left").select(
        "row", "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256", *(["key", (F.col("key") == F.col("last.key")).alias("once")] if keyed else []),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a larger id has; all columns stay. The rows
    to drop are matched by key, which the text itself need not be moved for when few."""
    out = groups(docs, id_col, text_col, keyed=True).filter(~F.col("kept")).select("key", "once")
    return dropped(docs, out, id_col, text_col)

"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions.

The items' words are cut into windows of WINDOW consecutive words (an item of fewer, but not none,
is one window). Of the corpus, an index of postings (row, term, position) is stored for the terms
that the items have, since no other term's list is ever read; term 0 stands for the row itself, with
its number of words as position. The index is split by documents: rows are dealt to buckets before
they are cut into words, each row's postings stand in one bucket, and whatever is grouped or joined
by row is done where it stands. So the texts move once, and no posting ever does.

Then, per distinct window, terms are ordered by their frequency in the corpus. The lists of its two
rarest terms, each moved back by the term's offset in the window, are intersected first; what
remains, few places beside true matches, is intersected with the lists of all other terms.
Everything is joined on exact terms. Exact phrases have every term at its place; proximity matches
have, for some start, every term at most `slop` places from its own.

Rows are told apart by a number that is given in the one scan that makes the index, so rows that
repeat spread over the buckets like any others, and a common term or passage over all tasks; what one
task must hold together is a single row. The tables about the items are broadcast only when they have
at most BROADCAST rows and BROADCAST_BYTES, both counted; beyond that Spark joins them as it sees fit.

Defined results: null texts have no words; empty and very long texts are read whole; rows with null
or repeated ids have each their own result, and rows that tie on all columns the same one; null
items, and items without words, never match; item ids are taken as strings; ids of rows may be of any
type; empty tables give no matches; other columns of any name are not read, and pass through
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.llm.common import ascii_lower, bucketed, row_key, settings, unused, without, words, written

WINDOW = 10
#: Rows and bytes of a table about the items that is broadcast, at most.
BROADCAST, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of text that a bucket of the index is planned for, and buckets at most (Spark's own bound).
BUCKET_BYTES, BUCKETS = 16 << 20, 100_000


def _bytes(df: DataFrame) -> Column:
    """About as many bytes as a row takes."""
    each = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            each = each + F.octet_length(F.array_join(f.name, " ")) + 16 * F.size(f.name)
        else:
            each = each + (F.octet_length(f.name) + 16 if isinstance(f.dataType, StringType) else F.lit(8))
    return each


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST rows of BROADCAST_BYTES together."""
    n, size = df.limit(BROADCAST + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST and size <= BROADCAST_BYTES else df


class Items:
    """The items' windows: ``windows`` (window, n), ``terms`` (window, offset, term id),
    ``members`` (item, window) and ``dictionary`` (word, term); each distinct window once."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW):
        cut = items.select(F.col(id_col).cast("string").alias("item"), words(ascii_lower(F.col(text_col))).alias("words")).filter("size(words) > 0")
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
        cut = cut.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(window)))).alias("phrase")).distinct()
        cut = written(cut, "windows")
        self.windows = written(cut.select("phrase").distinct().select("phrase", F.monotonically_increasing_id().alias("window"), F.size("phrase").alias("n")), "phrases")
        self.members = written(cut.join(_small(self.windows), "phrase").select("item", "window"), "members")
        vocabulary = self.windows.select(F.explode("phrase").alias("word")).distinct()
        self.dictionary = written(vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "terms")
        spread = self.windows.select("window", "n", F.posexplode("phrase").alias("offset", "word"))
        self.terms = written(spread.join(_small(self.dictionary), "word").select("window", "n", "offset", "term"), "window-terms")


def index(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """Postings, in buckets by row: row, term, pos, and for term 0, which marks the row itself, its
    id and, if keyed, its key (row_key). One pass over the texts, after one over their sizes; a
    posting is made where the word is in the dictionary."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = min(BUCKETS, max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES)))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(n, "row")
    key = row_key(F.col("id"), F.col("text")) if keyed else F.lit(None).cast("binary")
    own = own.select("row", "id", key.alias("key"), words(ascii_lower(F.col("text"))).alias("words"))
    each = own.select("row", "id", "key", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    dictionary = items.dictionary.union(spark.createDataFrame([("", 0)], "word string, term long"))
    found, whole = each.join(_small(dictionary), "word"), F.col("term") == 0
    postings = found.select("row", "term", F.when(whole, F.col("n")).otherwise(F.col("pos") - 1).alias("pos"), F.when(whole, F.col("id")).alias("id"), F.when(whole, F.col("key")).alias("key"))
    return bucketed(postings, "postings", "row", n)


def ranked(items: Items, postings: DataFrame) -> DataFrame:
    """The windows' terms with their rank, the rarest in the corpus first. A window of which a
    term has no postings can't match and is left out."""
    frequency = postings.filter("term > 0").groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("window").orderBy("df", "offset")
    own = items.terms.join(frequency, "term").withColumn("rank", F.row_number().over(order))
    whole = own.groupBy("window").agg(F.count("*").alias("present"))
    return written(own.join(whole, "window").filter("present = n").select("window", "n", "offset", "term", "rank"), "ranked-terms")


def _moved(slop: int) -> Column:
    """How far from its place a term may stand."""
    return F.explode(F.array(*(F.lit(k) for k in range(-slop, slop + 1)))).alias("away")


def _rarest(postings: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """row, window, n, start, exact: where the lists of the windows' two rarest terms meet, and
    whether they do so without a move. By row throughout, so nothing is shuffled."""
    lists = postings.filter("term > 0").join(_small(terms.filter("rank <= 2").select("term", "window", "n", "offset", "rank")), "term")
    starts = lists.select("row", "window", "n", "rank", (F.col("pos") - F.col("offset")).alias("start"))
    if slop:
        starts = starts.select("row", "window", "n", "rank", "start", _moved(slop)).withColumn("start", F.col("start") + F.col("away"))
    own = F.when(F.col("away") == 0, F.col("rank")) if slop else F.col("rank")
    met = starts.groupBy("row", "window", "n", "start").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.min(own).alias("c"), F.max(own).alias("d"))
    both = F.least(F.col("n"), F.lit(2)) - 1
    return met.filter(F.col("b") - F.col("a") == both).select("row", "window", "n", "start", F.coalesce(F.col("d") - F.col("c") == both, F.lit(False)).alias("exact"))


#: Lists are joined by (row, term, pos) where they stand, though their buckets are by row alone.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _met(postings: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """row, window, n, start, exact of the places where the lists of all a window's terms meet."""
    short = _rarest(postings, terms.filter("n <= 2"), slop)
    two = _rarest(postings, terms.filter("n > 2"), slop).withColumnRenamed("exact", "both")
    rest = _small(terms.filter("rank > 2").select("window", "offset", "term"))
    wanted = two.join(rest, "window").select("row", "window", "n", "start", "both", "offset", "term", (_moved(slop) if slop else F.lit(0).alias("away")))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset") + F.col("away"))
    lists = postings.filter("term > 0").select("row", "term", "pos")  # a row has a term at a place once
    held = wanted.join(lists, ["row", "term", "pos"])
    by = ["row", "window", "n", "start", "both"]
    if slop:
        held = held.groupBy(*by, "offset").agg(F.min(F.abs("away")).alias("away"))
    held = held.groupBy(*by).agg(F.count("*").alias("got"), F.count_if(F.col("away") == 0).alias("at_place")).filter("got = n - 2")
    long_ = held.select("row", "window", "n", "start", (F.col("both") & (F.col("at_place") == F.col("n") - 2)).alias("exact"))
    return short.unionByName(long_)


def matches(items: Items, postings: DataFrame, slop: int = 0) -> DataFrame:
    """row, window, n, start, exact: every place where a window's words stand, each at most `slop`
    places from its own, and whether each stands at its own."""
    terms = ranked(items, postings)
    with settings(postings.sparkSession, IN_PLACE):
        return written(_met(postings, terms, slop), "matches")


def near(items: Items, postings: DataFrame, slop: int) -> DataFrame:
    """Proximity matches: row, window, start where, for every term of the window, the row has a
    posting at most `slop` places from the term's place."""
    return matches(items, postings, slop).select("row", "window", "start")


def report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = 0, keyed: bool = False,
) -> DataFrame:
    """What summary() tells of an index that is made for it."""
    items = Items(benchmark, item_col, item_text_col, window)
    return summary(items, index(docs, items, id_col, text_col, keyed), slop)


def summary(items: Items, postings: DataFrame, slop: int = 0) -> DataFrame:
    """id, key, n_words, n_hit (words inside any exact match), n_items, items (sorted ids of exact
    matches), n_near (items with proximity matches, exact ones among them): a row per row indexed;
    key is null unless the index is keyed. An index can be asked again, as with another slop."""
    found = matches(items, postings, slop)
    exact = found.filter("exact")
    hit = exact.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    own = found.groupBy("row", "window").agg(F.max("exact").alias("exact")).join(items.members, "window")
    in_ = own.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_distinct("item").alias("n_near"))  # at most the items
    hit = written(in_.join(hit, "row", "left"), "hits")
    rows = postings.filter("term = 0").select("row", "id", "key", F.col("pos").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hit, "row", "left").select(
        "id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that hold a window of an item; all columns stay. The rows to drop are
    matched by key, as a row's number holds for one scan only."""
    out = report(docs, benchmark, id_col, text_col, keyed=True, **how).filter("n_hit > 0").select("key").distinct()
    key = unused(docs)
    return without(docs, docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))), out, key)

"""Acquisition: repositories of search pages, what of them is new, and their files, level by level."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.functions import text
from quarry.functions.shared import shared_path

PAGE = "items array<struct<full_name:string,contents_url:string>>"
ENTRY = "type string, name string, path string, url string, size long, download_url string"


def repositories(pages: DataFrame) -> DataFrame:
    """page, place, full_name, slug, contents_url of the items of pages (page, body); items
    without a name are left out, as are pages without items."""
    items = pages.select("page", F.posexplode(F.from_json("body", PAGE)["items"]).alias("place", "item"))
    own = items.select("page", "place", F.coalesce("item.full_name", F.lit("")).alias("full_name"), "item.contents_url").filter("full_name <> ''")
    return own.withColumns({"slug": text.slug(F.col("full_name")), "contents_url": text.contents_root(F.col("contents_url"))})


def readable(pages: DataFrame) -> DataFrame:
    """pages, if the body of each is JSON; else an error, as what an unreadable page lists is lost."""
    lost = [r.page for r in pages.filter(F.from_json("body", "map<string,string>").isNull()).select("page").limit(10).collect()]
    if lost:
        raise ValueError(f"pages {lost} of the search are no JSON")
    return pages


def new_repositories(found: DataFrame, seen: DataFrame, order=("page", "place")) -> DataFrame:
    """Each repository once, where it first stands, unless it was seen before."""
    first = Window.partitionBy("full_name").orderBy(*order)
    own = found.join(seen.select("full_name"), "full_name", "left_anti")
    return own.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def _parts() -> Column:
    """The elements of a listing's body as texts; null if it is no JSON."""
    body = F.trim("body")
    return F.from_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), "array<string>")


def entries(listings: DataFrame, *keep: str) -> DataFrame:
    """The entries of listings (body: a JSON list, or one object that counts as such); elements
    that aren't objects are left out."""
    one = listings.select(*keep, F.explode(_parts()).alias("entry")).filter(F.trim("entry").startswith("{"))
    return one.select(*keep, F.from_json("entry", ENTRY).alias("e")).select(*keep, "e.*")


def listed(fetched: DataFrame, *keep: str) -> DataFrame:
    """What listings (url, body, error: null or why there is none) come to: their entries, with a null
    error, and a row with url and error for each that failed or can't be read."""
    own = fetched.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))
    error = F.coalesce("error", F.when(_parts().isNull(), "the listing is no JSON"))
    lost = own.select(*keep, "url", error.alias("error")).filter("error is not null")
    return entries(own.filter("error is null"), *keep).withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def wanted_files(found: DataFrame, out: str = "", max_bytes: int = text.MAX_FILE_BYTES) -> DataFrame:
    """The file entries that are to be fetched, with the place to save each."""
    name = F.coalesce("name", F.lit(""))
    own = found.filter((F.col("type") == "file") & text.wanted(name, F.col("size"), F.col("download_url"), max_bytes=max_bytes))
    return own.withColumn("save_path", text.save_path(out, F.col("slug"), F.col("path"), name))


def expand(roots: DataFrame, lister: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """slug, depth and entry of every file below roots (slug, url), a level of folders at a time:
    lister gives the entries, with slug, of the folders (slug, url) of a level. Rows of its that have an
    error, if it has such a column, stand for folders that couldn't be listed, and are given too. A
    folder is listed once however often it is linked; each level's entries and folders are written, to
    a folder of one table, so that plans don't grow with the depth. Folders left behind max_depth levels
    are an error; unset, there is no bound."""
    spark, base = roots.sparkSession, shared_path(roots.sparkSession, "expanded")
    folders, entries = StructType([roots.schema["slug"], roots.schema["url"]]), None

    def read(schema: StructType, at: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/{at}")

    def frontier(found: DataFrame, depth: int) -> DataFrame:
        found.select("slug", "url").distinct().write.parquet(f"{base}/folders/depth={depth}")
        return read(folders, f"folders/depth={depth}")

    level = frontier(roots, 0)
    for depth in itertools.count():
        if level.isEmpty():
            break
        if depth == max_depth:
            raise RuntimeError(f"folders are left below {max_depth} levels")
        found = lister(level)
        entries = found.schema
        found.write.parquet(f"{base}/entries/depth={depth}")
        done = read(folders, "folders")
        below = read(entries, f"entries/depth={depth}").filter("type = 'dir'").select("slug", "url")
        level = frontier(below.join(done, ["slug", "url"], "left_anti"), depth + 1)
    if entries is None:
        return lister(level).filter("false").withColumn("depth", F.lit(0))
    found = read(StructType([*entries, StructField("depth", IntegerType())]), "entries")
    return found.filter((F.col("type") == "file") | (F.col("error").isNotNull() if "error" in found.columns else F.lit(False)))

"""Scalar expressions over names, addresses and paths; all are columns, none is a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_BYTES = 500 * 1024


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def wanted(name: Column, size: Column, download_url: Column, extensions=("go",), max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Whether a listed file is to be fetched: its extension, its size (unknown and 0 pass, the
    cap itself passes) and an address to fetch it from."""
    return extension(name).isin(*extensions) & (F.coalesce(size, F.lit(0)) <= max_bytes) & (F.coalesce(download_url, F.lit("")) != "")


def slug(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("__"))


def contents_root(contents_url: Column) -> Column:
    """The address of a listing without its template's end."""
    return F.regexp_replace(contents_url, r"\{\+path\}$", "")


def save_path(out: str, slug_: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(out), slug_, F.coalesce(path, name))


def next_link(header: Column) -> Column:
    """The target of the first link of a Link header whose relation is next; null without one.
    Links part at commas and their fields at semicolons; the last rel counts; a target that isn't
    in angle brackets is none."""
    links = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.split(F.trim(x), ";"))

    def rel(fields: Column) -> Column:
        own = F.filter(F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda f: F.trim(f)), lambda f: f.startswith("rel="))
        return F.regexp_replace(F.substring(F.try_element_at(own, F.lit(-1)), 5, 1 << 20), '^"+|"+$', "")

    def target(fields: Column) -> Column:
        return F.trim(F.element_at(fields, 1))

    hit = F.filter(links, lambda f: (rel(f) == "next") & target(f).startswith("<") & target(f).endswith(">"))
    return F.regexp_extract(target(F.try_element_at(hit, F.lit(1))), "^<(.*)>$", 1)


def search_url(base: str, query: Column, page: Column, per_page: int = 30) -> Column:
    return F.concat(F.lit(f"{base}/search/repositories?q="), F.url_encode(query), F.lit(f"&per_page={per_page}&page="), page.cast("string"))


def import_name(path: Column) -> Column:
    """The name that an import path gives: its last part, versions at its end left out."""
    return F.regexp_extract(path, r"([^/]+?)(?:/v[0-9]+)*/*$", 1)


def excerpt(message: Column, most: int = 200) -> Column:
    return F.substring(message, 1, most)


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, without white space at their ends and without blank ones."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: x != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), for which the value is worked out once, also where it stands in a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hashed(seed, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that a seed and some values decide, alike in any engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def order_key(seed, *parts: Column) -> Column:
    """Rows in the order of this are shuffled, the same way for a seed wherever they are."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def split(key: Column, val_frac: float = 0.05, seed: int = 0) -> Column:
    """train or val, decided by the key alone."""
    return F.when(hashed(seed, key) < int(val_frac * (1 << 32)), "val").otherwise("train")

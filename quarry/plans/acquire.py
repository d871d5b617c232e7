"""Acquisition end to end: search pages to new repositories to their files, stored by repository."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.shared import written
from quarry.operators import acquire
from quarry.sources import files, github
from quarry.sources.config import Acquire, parsed

log = logging.getLogger(__name__)


def run(spark: SparkSession, settings: Acquire, token: str | None = None, base: str = github.API, replies: str | None = None) -> DataFrame:
    """Stores the new repositories' files below settings.output_dir; returns slug, path, url, error of
    the listings and files that couldn't be fetched. Repositories are marked seen after their files
    are stored; one with an error that another try may mend isn't, and is taken up again by the next
    run. With replies, a folder of recorded ones, nothing is asked of the network."""
    try:
        log.info("requests left and allowed: %s", github.rate_status(token, base, github.opener(replies)))
    except (RuntimeError, *github.FAULTS) as e:
        log.warning("the rate status is unknown: %s", e)
    options = {k: v for k, v in (("token", token), ("replies", replies)) if v}
    pages = written(github.search(spark, settings.query, maxPages=settings.max_pages, base=base, **options), "pages")
    known = f"{settings.output_dir}/.seen-repos"
    new = written(acquire.new_repositories(acquire.repositories(acquire.readable(pages)), files.seen(spark, known)), "new")

    def lister(level: DataFrame) -> DataFrame:
        return acquire.listed(level.join(github.fetch(level, token, settings.concurrency, replies), "url"), "slug")

    found = written(acquire.expand(new.select("slug", F.col("contents_url").alias("url")), lister), "found")
    wanted = written(acquire.wanted_files(found, settings.output_dir, settings.max_file_bytes).drop("error"), "wanted")
    urls = wanted.select(F.col("download_url").alias("url")).distinct()
    got = written(github.fetch(urls, token, settings.concurrency, replies).withColumnRenamed("url", "download_url"), "fetched")
    stored = wanted.join(got, "download_url")
    files.save_files(stored.filter("error is null").select("slug", "path", F.col("body").alias("content")), f"{settings.output_dir}/files")
    lost = stored.filter("error is not null").select("slug", "path", F.col("download_url").alias("url"), "error", "gone")
    lost = written(lost.unionByName(found.filter("error is not null").select("slug", "path", "url", "error", F.lit(False).alias("gone"))), "lost")
    files.mark_seen(new.join(lost.filter("not gone").select("slug").distinct(), "slug", "left_anti"), known)
    return lost.drop("gone")


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    run(SparkSession.builder.getOrCreate(), parsed(Acquire), os.environ.get("GITHUB_TOKEN")).show()

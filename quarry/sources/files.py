"""Sources of files: folders, lists of paths, and the list of what was seen before."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import stripped


def file_system(uri: str):
    """The file system of an address and the path in it; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def go_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """path, length, content of the files below root whose names end in .go, case and all. The cap
    on length is pushed to the scan, and content isn't read where it is not selected. Files of no
    bytes, which would be refused, are not listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", "true").load(root)
    found = found.select("path", "length", "content")
    return found if max_bytes is None else found.filter(F.col("length") <= max_bytes)


def listed_paths(spark: SparkSession, list_file: str) -> DataFrame:
    """path: the lines of a text file, trimmed, without blank ones."""
    return spark.read.text(list_file).select(stripped(F.col("value")).alias("path")).filter("path <> ''")


def read_paths(paths: DataFrame) -> DataFrame:
    """path, content, error: files read whole by name, wherever pyarrow.fs can; one that can't be
    read has an error and no content, and stops nothing. Other columns of paths are passed on."""
    keep = [c for c in paths.columns if c != "path"]

    def run(stream: Iterable[pa.RecordBatch]):
        for batch in stream:
            for k, path in enumerate(batch.column("path").to_pylist()):
                content, error = None, None
                try:
                    where, at = file_system(path)
                    with where.open_input_stream(at) as f:
                        content = f.read()
                except (OSError, pa.ArrowInvalid) as e:
                    error = str(e)[:200]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string()), *(batch.column(c).slice(k, 1) for c in keep)], ["path", "content", "error", *keep])

    own = paths.select("path", *keep)
    more = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, f"path string, content binary, error string{more}")


def seen(spark: SparkSession, path: str) -> DataFrame:
    """full_name: the list of what was taken before; empty where there is no list."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "full_name string")
    return spark.read.text(path).select(stripped(F.col("value")).alias("full_name")).filter("full_name <> ''").distinct()


def mark_seen(names: DataFrame, path: str) -> None:
    """Appends names to the list. To be called once their files are stored: a crash before then
    loses nothing, as the names come again."""
    names.select(F.col("full_name").alias("value")).write.mode("append").text(path)


def save_files(files: DataFrame, path: str) -> None:
    """Stores slug, path, content as Parquet, a folder for each slug; those of this run replace
    what was there of the same slugs."""
    files.select("slug", "path", "content").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


def export_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each content to root/slug/path as a file of its own; returns path, bytes."""

    def run(stream: Iterable[pa.RecordBatch]):
        where, top = file_system(root)
        for batch in stream:
            rows = []
            for r in batch.to_pylist():
                parts = [p for p in f"{r['slug']}/{r['path']}".split("/") if p not in ("", ".", "..")]
                at = "/".join([top, *parts])
                where.create_dir(at.rpartition("/")[0], recursive=True)
                with where.open_output_stream(at) as f:
                    f.write(r["content"])
                rows.append((at, len(r["content"])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "bytes"])

    return files.select("slug", "path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")

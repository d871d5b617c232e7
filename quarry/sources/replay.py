"""Recorded replies: what a service answered, kept as files, for runs without a network.

A folder has a JSON file for each reply, named by a digest of its address and its number among the
replies to that address. A reader gives them in order, and the last one again from then on."""

from __future__ import annotations

import base64
import hashlib
import json
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.files import file_system
from quarry.sources.github import Reply


def _name(url: str, number: int) -> str:
    return f"{hashlib.sha256(url.encode()).hexdigest()}-{number}.json"


def record(replies: DataFrame, folder: str) -> DataFrame:
    """Stores replies (url, number from 0, status, headers map, body binary) in folder; returns the
    url and number of those stored. A reply that is stored again replaces itself."""

    def run(stream: Iterable[pa.RecordBatch]):
        where, root = file_system(folder)
        where.create_dir(root, recursive=True)
        for batch in stream:
            for r in batch.to_pylist():
                own = {"url": r["url"], "status": r["status"], "headers": dict(r["headers"] or ()), "body": base64.b64encode(r["body"] or b"").decode()}
                with where.open_output_stream(f"{root}/{_name(r['url'], r['number'])}") as f:
                    f.write(json.dumps(own).encode())
            yield pa.RecordBatch.from_arrays([batch.column("url"), batch.column("number")], ["url", "number"])

    own = replies.select("url", F.col("number").cast("int").alias("number"), F.col("status").cast("int").alias("status"), "headers", F.col("body").cast("binary").alias("body"))
    return own.mapInArrow(run, "url string, number int")


class Recorded:
    """Something to make requests by, which answers from a folder and waits for nothing; an address
    that has no reply there is answered by status 404."""

    def __init__(self, folder: str):
        self.where, self.root = file_system(folder)
        self.asked: Counter[str] = Counter()

    def __call__(self, url: str, _headers: dict[str, str]) -> Reply:
        for number in range(self.asked[url], -1, -1):
            try:
                with self.where.open_input_stream(f"{self.root}/{_name(url, number)}") as f:
                    own = json.loads(f.read())
            except FileNotFoundError:
                continue
            self.asked[url] = number + 1
            return Reply(own["status"], base64.b64decode(own["body"]), own["headers"])
        return Reply(404, b"no reply is recorded")

    def sleep(self, _seconds: float) -> None:
        pass

"""Token ids as length-delimited binary records, with a separate offset index.

A file is records back to back, in ascending order of id:

    length   8 bytes, little-endian, of the payload
    check    4 bytes, masked CRC-32 of those 8 bytes
    payload  flag (1 byte: the id is null), id (8 bytes, signed), ids (2 bytes each, or 4 where the
             vocabulary needs them; the manifest says which)
    check    4 bytes, masked CRC-32 of the payload

and beside it ``.idx`` has the 8-byte offset of each record, so that a shuffled reader can open any
record at once. A checksum c is masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32, as usual for
checksums that stand within checked data.

Rows are dealt to tasks by ranges of id, ties by a hash of the text, then by their place in the scan,
so that rows which repeat are dealt like any others; each task sorts its range (Spark spills), encodes
it and writes it as a stream, to one file after another. Two attempts at a task write two files; the
manifest, a Spark table, names the one whose task committed. Files are written and read through
``pyarrow.fs``, so the folder can be any that it knows. ``read`` streams files in order; ``shuffled``
deals single records, by the index, in a seeded order over all files.

Defined results: null and empty texts give the end id alone; texts of any length are one record; ids
are whole numbers, and any other type is an error; null ids come first; rows that tie on id are ordered
by a hash of their text, equal rows anyhow; an empty table gives an empty manifest; other columns of
any name are not read. A damaged record raises an error when read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.llm import pretokens
from quarry.llm.common import shared_path, written

#: Bytes of text that a range of ids is planned for, ranges at most, and the number of times
#: FILE_BYTES after which a range goes on in another file.
FILE_BYTES, RANGES, ROLL = 32 << 20, 200_000, 4
#: Files that a shuffled reader's task holds open, and records of a task.
OPEN, DEALT = 64, 20_000
#: Pieces that the library encodes in a call; what it gives back is large beside their ids.
AT_ONCE = 2000
MANIFEST = "part int, number int, path string, n_records long, n_ids long, width int"
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
ROW = struct.Struct("<?q")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def unframe(read, offset: int | None = None) -> bytes | None:
    """The next payload of a file whose bytes read(n) gives; None at its end."""
    head = read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"damaged length at offset {offset}")
    payload, tail = read(size), read(TAIL.size)
    if len(payload) != size or masked(payload) != TAIL.unpack(tail)[0]:
        raise ValueError(f"damaged record at offset {offset}")
    return payload


def file_system(uri: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def payload_of(key: int | None, ids: np.ndarray, width: int) -> bytes:
    return ROW.pack(key is None, key or 0) + ids.astype(f"<u{width}").tobytes()


def content(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    null, key = ROW.unpack_from(payload)
    return (None if null else key), np.frombuffer(payload, f"<u{width}", offset=ROW.size)


class Encoding:
    """A vocabulary of the tokenizers library, through a table of pieces. The library encodes
    pieces that its own pre-tokenizer would cut alike, so their ids joined are the text's."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path) as f:
            plain = json.load(f)
        steps = plain["pre_tokenizer"]
        self.by_piece = plain.get("normalizer") is None and steps == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": steps.get("trim_offsets"), "use_regex": True}
        import public_tokenizers

        self.split = pretokens.byte_level(public_tokenizers.PATTERN)
        byte = {i: len(t) for t, i in plain["model"]["vocab"].items()} if self.by_piece else {}  # a character a byte
        self.bytes = np.array([byte.get(i, 0) for i in range(max(byte, default=0) + 1)], np.int64)
        self.table = pretokens.Table(self._make)

    def _make(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library gives the ids of AT_ONCE pieces in a row; bytes tell where each piece ends."""
        parts = [[p.decode() for p in pieces[k : k + AT_ONCE]] for k in range(0, len(pieces), AT_ONCE)]
        found = [np.array(self.tokenizer.encode_batch_fast([x], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32) for x in parts]
        found = np.concatenate([*found, np.zeros(0, np.int32)])
        ends = np.cumsum([len(p) for p in pieces])
        upto = np.searchsorted(np.cumsum(self.bytes[found]), ends, "left") + 1
        return found, np.diff(upto, prepend=0)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return pretokens.by_text(texts, self.split, self.table)


def encoding(path: str) -> Encoding:
    return pretokens.held(("records", path), lambda: Encoding(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of docs to files in folder; returns the manifest, MANIFEST."""
    path = path or default_path()
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; records have whole numbers as ids")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(RANGES, max(1, -(-total // file_bytes)))
    key = [F.asc_nulls_first("id"), F.xxhash64("text"), F.col("place")]
    dealt = own.repartitionByRange(ranges, *key).sortWithinPartitions(*key).drop("place")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoding(path)
        part, attempt = context.partitionId(), f"{context.stageId()}-{context.taskAttemptId()}"
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        done, out, offsets, n_ids, place = [], None, [], 0, 0

        def close() -> None:
            out.close()
            name = f"part-{part:06d}-{len(done):06d}-{attempt}"
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            done.append((part, len(done), f"{folder}/{name}.rec", len(offsets), n_ids, encode.width))

        for batch, texts in pretokens.batches(stream):
            for key, ids in zip(batch.column("id").to_pylist(), encode(texts), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/part-{part:06d}-{len(done):06d}-{attempt}.rec", buffer_size=1 << 20)
                    offsets, n_ids, place = [], 0, 0
                record = frame(payload_of(key, np.append(ids, end_id), encode.width))
                out.write(record)
                offsets.append(place)
                place += len(record)
                n_ids += len(ids) + 1
                if place >= ROLL * file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["part", "number", "path", "n_records", "n_ids", "width"])

    return written(dealt.mapInArrow(run, MANIFEST).repartition(1), "manifest")  # a row a file


def read(manifest: DataFrame) -> DataFrame:
    """id, start (ids of all records before it), n_tokens, ids_crc32: read from the files, every
    checksum tested. A task reads one file as a stream; the first ids of the files are sums over
    the manifest, a row a file."""
    files = manifest.count()
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).withColumn("slot", F.row_number().over(Window.orderBy("part", "number")) - 1)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                fs, path = file_system(r["path"])
                start, count, rows = r["base"], 0, []
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    while (payload := unframe(f.read)) is not None:
                        key, ids = content(payload, r["width"])
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        count += 1
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if count != r["n_records"] or start != r["base"] + r["n_ids"]:
                    raise ValueError(f"{r['path']} lacks records")
                yield _rows(rows)

    return base.repartitionById(max(1, files), F.col("slot").cast("int")).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "start", "n_tokens", "ids_crc32"])


class _Reader:
    """Records of some files by their number, through the offset indexes; keeps OPEN files open."""

    def __init__(self):
        self.held: OrderedDict[str, tuple] = OrderedDict()

    def __call__(self, path: str, number: int, width: int) -> tuple[int | None, np.ndarray]:
        if path not in self.held:
            fs, at = file_system(path)
            self.held[path] = fs.open_input_file(f"{at.removesuffix('.rec')}.idx"), fs.open_input_file(at)
            if len(self.held) > OPEN:
                for f in self.held.popitem(last=False)[1]:
                    f.close()
        self.held.move_to_end(path)
        index, records = self.held[path]
        offset = int(np.frombuffer(index.read_at(8, 8 * number), "<u8")[0])
        records.seek(offset)
        return content(unframe(records.read, offset), width)

    def close(self) -> None:
        for files in self.held.values():
            for f in files:
                f.close()
        self.held.clear()


def open_record(path: str, number: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """A record by its number in the file, through the offset index: (id, ids)."""
    reader = _Reader()
    try:
        return reader(path, number, width)
    finally:
        reader.close()


def shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """place, id, ids: every record once, place (from 0) its rank in an order over all files that the
    seed decides. Some DEALT records go to a task by ranges of a hash, so that no task has more than
    its share; a record is read by its offset, whatever file it is in."""
    every = manifest.select("path", "width", F.xxhash64(F.lit(seed), "part", "number").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)).alias("number"))
    every = every.withColumn("order", F.xxhash64("file", "number")).drop("file")
    total = manifest.agg(F.sum("n_records")).first()[0] or 0
    parts = max(1, -(-total // DEALT))
    part = F.floor((F.col("order") / F.lit(2.0**64) + F.lit(0.5)) * parts).cast("int")  # of all hashes, in order
    dealt = written(every.withColumn("part", F.greatest(F.lit(0), F.least(part, F.lit(parts - 1)))), "shuffled")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a task
    inside = Window.partitionBy("part").orderBy("order", "path", "number")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(first, "part").select("part", (F.col("first") + F.col("rank")).alias("place"), "path", "number", "width")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        try:
            for batch in stream:
                for at in range(0, batch.num_rows, 100):
                    rows = batch.slice(at, 100).to_pylist()
                    got = [reader(r["path"], r["number"], r["width"]) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([r["place"] for r in rows], pa.int64()), pa.array([k for k, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32()))], ["place", "id", "ids"])
        finally:
            reader.close()

    return ranked.repartition(parts, "part").sortWithinPartitions("place").mapInArrow(run, "place long, id long, ids array<int>")


def fresh_folder(spark: SparkSession) -> str:
    return shared_path(spark, "records")

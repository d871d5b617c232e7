"""Go sources to structural tokens, and what couldn't be parsed to quarantine."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text, vocab

#: Nested calls that a worker allows, which bounds how deep a file may nest.
DEPTH = 60_000


def tokens_or_error(source: str | bytes | None) -> tuple[list[str] | None, str | None]:
    """(tokens, None), or (None, why) for a source that is not Go, nests too deep or is no UTF-8."""
    from quarry.functions.golang.scanner import SyntaxFault
    from quarry.functions.golang.walk import tokens

    if source is None:
        return None, "no content"
    try:
        code = source if isinstance(source, str) else bytes(source).decode()
        return tokens(code), None
    except UnicodeDecodeError as e:
        return None, f"illegal UTF-8 encoding at byte {e.start}"
    except SyntaxFault as e:
        line = code.count("\n", 0, e.at) + 1
        return None, f"{line}:{e.at - code.rfind(chr(10), 0, e.at)}: {e.message}"
    except RecursionError:
        return None, "unsupported: nested too deep"


def spread(files: DataFrame) -> DataFrame:
    """files over all cores if they come in fewer parts than there are; parsing is worth the move."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def _lists(found: list[list | None], arrow: pa.DataType) -> pa.ListArray:
    """Lists, or nulls, as an array; faster than from nested lists."""
    flat, offsets = [], []
    for own in found:
        offsets.append(None if own is None else len(flat))
        flat += own or ()
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), pa.array(flat, arrow))


def _parsed(files: DataFrame, source: str, column: str, type_: T.DataType, arrow: pa.DataType, made) -> DataFrame:
    keep = [c for c in files.columns if c != source]

    def run(stream):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for batch in stream:
            found = [tokens_or_error(x) for x in batch.column(source).to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, _lists([t and made(t) for t, _ in found], arrow), pa.array([e for _, e in found], pa.string())], [*keep, column, "error"])

    fields = [f for f in files.schema.fields if f.name != source]
    return files.mapInArrow(run, T.StructType([*fields, T.StructField(column, type_), T.StructField("error", T.StringType())]))


def tokenized(files: DataFrame, source: str = "content") -> DataFrame:
    """files with tokens (null if refused) and error (null if not); the source column is dropped.

    Rows are read in Arrow batches, set small by ``spark.sql.execution.arrow.maxRecordsPerBatch``
    where sources are long. Nothing is shuffled; see spread() for files that come in few parts."""
    return _parsed(files, source, "tokens", T.ArrayType(T.StringType()), pa.string(), list)


def tokenized_ids(files: DataFrame, source: str = "content") -> DataFrame:
    """Like tokenized() and encoded() together, with ids made where the tokens are, so that no token
    crosses as text; tokens that the vocabulary lacks are dropped."""
    return _parsed(files, source, "ids", T.ArrayType(T.IntegerType()), pa.int32(), lambda tokens: [i for i in map(vocab.IDS.get, tokens) if i is not None])


def accepted(found: DataFrame) -> DataFrame:
    return found.filter(F.col("error").isNull()).drop("error")


def quarantine(found: DataFrame) -> DataFrame:
    """path and error of the files that were refused; errors are told in 200 characters at most."""
    return found.filter(F.col("error").isNotNull()).drop("tokens").withColumn("error", text.excerpt(F.col("error")))


def require_some(found: DataFrame) -> None:
    """Fails if there were files and none was accepted."""
    if found.filter(F.col("error").isNull()).isEmpty() and not found.isEmpty():
        raise RuntimeError("no file could be tokenized")


def encoded(found: DataFrame) -> DataFrame:
    """tokens become ids, array<int>; tokens that the vocabulary lacks are dropped."""
    return found.withColumn("ids", vocab.encode(F.col("tokens"))).drop("tokens")


def unknown_tokens(found: DataFrame) -> DataFrame:
    """token, n: what the walk gave and the vocabulary lacks; empty unless the two drift apart."""
    return found.select(F.explode("tokens").alias("token")).join(vocab.table(found.sparkSession).select("token"), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"))


def token_lines(found: DataFrame, path: str) -> None:
    """Writes one token a line, each file's tokens together and in order."""
    found.filter("tokens is not null").select(F.array_join("tokens", "\n").alias("value")).write.text(path)


def streams_of_lines(outputs: DataFrame, output: str = "output", begin: str = "BOS") -> DataFrame:
    """outputs with stream (from 0), ids and unknown (what the vocabulary lacks, in order), a row for
    each stream of an output: lines are trimmed, blank ones dropped, and what precedes the first
    beginning belongs to no stream. Within the row; an output is what one call of a tokenizer gave."""
    tokens = text.lines(F.col(output))
    begins = F.filter(F.transform(tokens, lambda t, i: F.when(t == begin, i + 1)), lambda i: i.isNotNull())
    one = outputs.withColumn("__tokens", tokens).select("*", F.posexplode(begins).alias("stream", "__at"), F.size("__tokens").alias("__n"), begins.alias("__begins"))
    stop = F.coalesce(F.get("__begins", F.col("stream") + 1), F.col("__n") + 1)
    own = F.slice("__tokens", F.col("__at"), stop - F.col("__at"))
    known = F.array(*map(F.lit, vocab.TOKENS))
    out = one.withColumns({"ids": vocab.encode(own), "unknown": F.filter(own, lambda t: ~F.array_contains(known, t))})
    return out.drop(output, "__tokens", "__at", "__n", "__begins")


def streams(lines: DataFrame, order: str, token: str = "token", begin: str = "BOS") -> DataFrame:
    """lines with stream_no: how many beginnings there are up to each, in a known order; what
    precedes the first belongs to no stream and is left out."""
    from quarry.operators.pack import running_total

    out = running_total(lines.withColumn("__begins", (F.col(token) == begin).cast("long")), order, "__begins", "stream_no")
    return out.filter("stream_no > 0").drop("__begins")

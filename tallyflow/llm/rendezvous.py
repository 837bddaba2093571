"""Questions that chunks of documents ask each other through hash buckets.

Documents are dealt into chunks by a hash of their id and text. Each chunk groups what it asks about (hashes, fragments) by bucket,
once per distinct value, and sends a few packed messages instead of a row per position. A bucket answers each message with a
packed reply, which goes back to the chunk. A value that a third of all rows hold is one entry per chunk; neither chunks
nor buckets depend on any key of the data, so none is hot. All of it is plain grouping: lost executors are recomputed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 3 << 20
#: Texts that a Python worker is sent at once. A batch is held twice, on either side.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 8 << 20
MESSAGES = "chunk long, bucket long, message binary"
REPLIES = "chunk long, bucket long, reply binary"
_JOIN = re.compile(r"\bJoin (Inner|Left|Right|Full|Cross)")
_MESSAGES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("message", pa.binary())])
_REPLIES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])


def stored_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; measured where it has none (frames made from local rows), and behind joins, for which
    it takes the product of the sides."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < 1 << 50 and not _JOIN.search(plan.toString()):
        return size
    strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(sum(df.agg(*strings).first())) if strings else 0


def pieces(df: DataFrame, size: int = CHUNK_BYTES) -> int:
    """How many pieces of about ``size`` stored bytes a frame makes; at least four per core. Results don't depend on it."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(stored_bytes(df) / size))


def chunked(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(chunk, doc_id, text) of the rows that have an id."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.where("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), "doc_id", "text")


def messages(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    buckets, payloads = zip(*rows, strict=True) if rows else ((), ())
    return pa.table([pa.array([chunk] * len(rows), pa.int64()), pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], schema=_MESSAGES)


def ask(chunks: DataFrame, question: Callable[[pa.Table], list[tuple[int, bytes]]], replies: DataFrame | None = None) -> DataFrame:
    """Messages of every chunk. ``question`` takes the chunk's rows and, after a first round, {bucket: reply}."""
    if replies is None:
        return chunks.groupBy("chunk").applyInArrow(lambda key, rows: messages(key[0].as_py(), question(rows)), MESSAGES)

    def again(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        return messages(key[0].as_py(), question(rows, _told(told)))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(again, MESSAGES)


def _told(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("reply").to_pylist(), strict=True))


def answer(asked: DataFrame, meet: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Replies of every bucket, one per message. Buckets below 0 hold notes of a chunk to itself, returned as they are."""

    def reply(key: tuple, rows: pa.Table) -> pa.Table:
        got = rows.column("message").to_pylist()
        out = meet(got) if key[0].as_py() >= 0 else got
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array(out, pa.binary())], schema=_REPLIES)

    return asked.groupBy("bucket").applyInArrow(reply, REPLIES)


def conclude(chunks: DataFrame, replies: DataFrame, result: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """What every chunk makes of its rows and the replies."""
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda rows, told: result(rows, _told(told)), schema)


def note(chunk: int) -> int:
    """The bucket of a chunk's note to itself."""
    return -1 - chunk


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash. It follows the order of the hashes, so sorted hashes fall into buckets as runs."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_runs(hashes: np.ndarray, n: int):
    """(bucket, start, end) of the runs of sorted hashes."""
    if len(hashes):
        buckets = bucket_of(hashes, n)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1])
        yield from zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True)


def in_order(told: dict[int, bytes]) -> list[bytes]:
    """The replies of the true buckets in their order."""
    return [told[b] for b in sorted(told) if b >= 0]


def bound_batches(spark: SparkSession) -> None:
    """Let the session send at most MOST_BATCH_BYTES to a Python worker at once; a smaller setting stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > MOST_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir. Where it is unset, only a local master may use one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root

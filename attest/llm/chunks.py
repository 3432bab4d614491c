"""Documents in chunks of a few megabytes, and questions that all chunks ask at once.

A chunk is some documents that one task handles with arrays. The chunked table is written once, bucketed by chunk, so
that later steps meet their chunk again without moving a text. Between chunks only packed questions travel: a chunk
sends each bucket of a hash space the sorted hashes it has there, each once, in one row; the bucket compares them and
answers one bit (or count) for each in the same order. A hash that every document holds is one entry a chunk. A bucket is one group of a task: there are as many as the bytes of text
need for each to stay small, so its memory does not grow with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.words import pieces
from attest.session import shared_dir, ship_with_plans, written

ship_with_plans(__name__)

CHUNK_BYTES = 4_000_000
#: Bytes of text for each bucket, so that buckets keep their size as the input grows.
BUCKET_BYTES = 2_000_000
#: Stands for a chunk in what a bucket says of itself.
BUCKET = -1
MESSAGE = "bucket int, chunk long, payload binary"
ANSWER = "chunk long, step int, bucket int, payload binary"


class Chunks:
    """The ``key`` (cast to long) and ``text`` (bytes) of all rows of ``docs``, in chunks."""

    def __init__(self, docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES,
                 bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None):
        spark = docs.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, size = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                for some in pieces(batch, "text", chunk_bytes):
                    if size and size + some.nbytes > chunk_bytes:
                        chunk, size = chunk + 1, 0
                    size += some.nbytes
                    names, sizes = pa.array(np.full(len(some), chunk)), pc.binary_length(some.column("text")).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([names, *some.columns, sizes], ["chunk", "key", "text", "size"])

        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
        name = f"chunks_{uuid.uuid4().hex}"
        writer = rows.mapInArrow(cut, "chunk long, key long, text binary, size long").write.bucketBy(self.parts, "chunk")
        writer.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        self.table = spark.table(name).drop("size")
        held = spark.table(name).agg(F.sum("size")).first()[0] or 0
        self.buckets = buckets or max(2, -(-held // bucket_bytes))

    def ask(self, question: Callable, answer: Callable, step: int, known: DataFrame | None = None) -> DataFrame:
        """Answers ``chunk, step, bucket, payload`` to what ``question`` yields for each chunk, as a written table.

        ``question(rows, answers)`` gives (bucket, payload) pairs, ``answer(payloads)`` a payload for each of a bucket's
        and may add one for the bucket itself, which comes as chunk ``BUCKET``.
        """

        def send(rows: pa.Table, answers: pa.Table | None) -> pa.Table:
            found = list(question(rows, answers))
            chunk = rows.column("chunk")[0].as_py() if len(rows) else 0
            return pa.table([
                pa.array([b for b, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int64()),
                pa.array([p for _, p in found], pa.binary())], ["bucket", "chunk", "payload"])

        def reply(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("chunk")
            payloads, n = answer(rows.column("payload").to_pylist()), len(rows)
            chunks, bucket = rows.column("chunk").to_pylist(), rows.column("bucket")[0].as_py()
            chunks += [BUCKET] * (len(payloads) - n)
            return pa.table([
                pa.array(chunks, pa.int64()), pa.array([step] * len(chunks), pa.int32()),
                pa.array([bucket] * len(chunks), pa.int32()), pa.array(payloads, pa.binary())], ["chunk", "step", "bucket", "payload"])

        sent = self._each(send, MESSAGE, known)
        return written(sent.groupBy("bucket").applyInArrow(reply, ANSWER), "answers")

    def finish(self, result: Callable, schema: str, known: DataFrame | None) -> DataFrame:
        """Rows that ``result(rows, answers)`` gives for each chunk."""
        return self._each(result, schema, known)

    def _each(self, function: Callable, schema: str, known: DataFrame | None) -> DataFrame:
        if known is None:
            return self.table.groupBy("chunk").applyInArrow(lambda rows: function(rows, None), schema)
        # A chunk without questions has no answers; every group has rows of the table.
        return self.table.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(function, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper bits, so that sorted hashes come in the order of their buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(hashes: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(payload: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(payload) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(payload, np.uint8).reshape(-1, size)
    return out.view("<u8")[:, 0]


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes as one value and steps of as many bytes as the largest needs: close ones take fewer bytes."""
    steps = np.diff(hashes)
    size = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return np.array([len(hashes), size], "<i8").tobytes() + hashes[:1].astype("<u8").tobytes() + packed(steps, size)


def unpack_sorted(payload: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The hashes packed at a place of a payload, and where they end."""
    n, size = np.frombuffer(payload, "<i8", 2, at).tolist()
    at += 16
    if not n:
        return np.zeros(0, np.uint64), at
    end = at + 8 + size * (n - 1)
    return np.cumsum(np.concatenate([np.frombuffer(payload, "<u8", 1, at), unpacked(payload[at + 8 : end], size)]), dtype=np.uint64), end


def by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes."""
    of = bucket_of(hashes, buckets)
    cuts = np.flatnonzero(np.diff(of)) + 1
    edges = [0, *cuts.tolist(), len(of)] if len(of) else [0]
    return [(int(of[a]), a, b) for a, b in zip(edges[:-1], edges[1:])]


def answers_of(answers: pa.Table | None, step: int) -> list[bytes]:
    """The payloads of one step in the order of their buckets."""
    if answers is None or not len(answers):
        return []
    rows = sorted(zip(answers.column("step").to_pylist(), answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()))
    return [p for s, _, p in rows if s == step]


def bits_of(payloads: list[bytes], sizes: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(p, np.uint8))[:n] for p, n in zip(payloads, sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def split_bits(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, sizes)]


def shared_by_chunks(size: int) -> Callable[[list[bytes]], list[bytes]]:
    """Answer: which of the hashes another chunk has too."""

    def answer(payloads: list[bytes]) -> list[bytes]:
        hashes = np.concatenate([unpacked(p, size) for p in payloads])
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        flags = np.zeros(len(hashes), bool)
        flags[order[1:]] |= same
        flags[order[:-1]] |= same
        return split_bits(flags, [len(p) // size for p in payloads])

    return answer


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on once more as 64-bit integers."""
    large = counts[counts >= 255].astype("<i8")
    return np.int64(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(payload: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The counts packed at a place of a payload, and where they end."""
    n = int(np.frombuffer(payload, "<i8", 1, at)[0])
    counts = np.frombuffer(payload, np.uint8, n, at + 8).astype(np.int64)
    large = counts == 255
    many = int(large.sum())
    counts[large] = np.frombuffer(payload[at + 8 + n : at + 8 + n + 8 * many], "<i8")
    return counts, at + 8 + n + 8 * many

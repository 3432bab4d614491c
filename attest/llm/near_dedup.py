"""Near-duplicates: SimHash fingerprints linked by covering locality-sensitive hashing.

A covering family maps each of the 64 bit positions to a nonzero vector of ``radius + 1`` bits; the mask of a nonzero
vector v keeps the positions whose vector has odd inner product with v. At most ``radius`` differing positions leave
some v orthogonal to all of them, so every pair within the radius agrees on that mask: no link can be missed. Copies
are folded to one row per fingerprint before the tables are made, so a group of copies of any size is one row.

A table's bucket of more than ``BUCKET`` fingerprints (they already agree on about 34 bits) is not compared but sent
to a second covering family over the bits that are left, which keeps about half of those; its buckets hold at most
some 2^16 fingerprints whatever the data, because only that many differ in the bits left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.components import components
from attest.llm.names import unused
from attest.session import ship_with_plans, written

ship_with_plans(__name__)

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints of one bucket that are compared at once; larger buckets are cut by the second family.
BUCKET = 4096
_ROWS = 1 << 14


def simhash(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of the ASCII-lower-cased word shingles; zero without words."""
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), _ROWS):
        pairs = zip(starts[at : at + _ROWS], last[at : at + _ROWS])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprint(F.col(text).cast("binary")))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions: any ``radius`` of them are all left out by some mask."""
    size = 1 << (radius + 1)
    vectors = {bit: 1 + i % (size - 1) for i, bit in enumerate(bits)}
    return [sum(1 << b for b, u in vectors.items() if (u & v).bit_count() & 1) for v in range(1, size)]


def two_level_masks(radius: int = RADIUS) -> tuple[list[int], list[list[int]]]:
    first = covering_masks(list(range(64)), radius)
    second = [[m | n for n in covering_masks([b for b in range(64) if not m >> b & 1], radius)] for m in first]
    return first, second


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(codes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct long ``fp`` that join exactly the components of pairs within ``radius``."""
    first, second = two_level_masks(radius)
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("k")) for t, m in enumerate(first)]
    rows = codes.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.k", "fp")
    found = written(_compare(rows, radius, bucket), "covering")
    # The second family of every table: masks by table and position, bounded by the radius alone.
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in second])
    wide = found.where("b is null").select(F.col("a").alias("fp"), "t", F.posexplode(F.get(masks, F.col("t"))).alias("i", "m"))
    finer = wide.select((F.col("t") * len(first) + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    links = found.where("b is not null").unionByName(_compare(finer, radius, None))
    return links.select("a", "b").distinct()


def _compare(rows: DataFrame, radius: int, bucket: int | None) -> DataFrame:
    """Links inside buckets ``(t, k)`` of ``fp``; rows with a null ``b`` are those of buckets above ``bucket``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group, over in _buckets(batches, bucket):
            a, b = (group, None) if over else linked(group, radius)
            if len(a):
                columns = [a.view(np.int64), np.full(len(a), t, np.int32)]
                rest = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), rest, pa.array(columns[1])], ["a", "b", "t"])

    together = rows.repartition("t", "k").sortWithinPartitions("t", "k")
    return together.mapInArrow(run, "a long, b long, t int")


def _buckets(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Buckets of two or more in a sorted stream, whole or, above ``most``, in pieces marked True."""
    t0 = k0 = None
    held: list[np.ndarray] = []
    size, over = 0, False
    for batch in batches:
        t, k, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        edges = [0, *cuts.tolist(), len(t)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if (t[lo], k[lo]) != (t0, k0):
                if over or size > 1:
                    yield int(t0), np.concatenate(held), over
                t0, k0, held, size, over = t[lo], k[lo], [], 0, False
            held.append(fp[lo:hi])
            size += hi - lo
            if most is not None and size > most:
                yield int(t0), np.concatenate(held), True
                held, over = [], True
                held.append(fp[:0])
    if over or size > 1:
        yield int(t0), np.concatenate(held), over


def linked(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs within the radius: each code but a component's first, with that first."""
    left = np.unique(codes)
    members, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            near = np.zeros(len(left), bool)
            for code in some:
                near |= np.bitwise_count(left ^ code) <= radius
            if near.any():
                members.append(left[near])
                roots.append(np.full(int(near.sum()), root, np.uint64))
                front = np.concatenate([front, left[near]])
                left = left[~near]
    if not members:
        return codes[:0], codes[:0]
    return np.concatenate(members), np.concatenate(roots)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    bucket: int = BUCKET) -> DataFrame:
    """``key, print, fp, root, fingerprint, component_id``, one row for each row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest non-null key reachable.
    A null or empty text has fingerprint zero and is linked like any other. A null key takes part in links; its
    component is null when no key in it is known. ``root`` names the component by its smallest fingerprint and
    ``print`` is a hash of the text. Repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(key), F.xxhash64(text).alias("print"), F.col(text).alias("__text"))
    prints = written(with_fingerprint(rows, "__text").drop("__text"), "prints")
    codes = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "codes")
    roots = components(near_links(codes.select("fp"), radius, bucket))
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left")
    rooted = written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        key, "print", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates: that with the smallest key (nulls last, then by text hash)."""
    found = near_duplicates(docs, key, text, **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "print")).alias("s"))
    first = first.select(F.col("s.k").alias("__key"), F.col("s.print").alias("__print"))
    same = docs[key].eqNullSafe(first["__key"]) & (F.xxhash64(docs[text]) == first["__print"])
    (mark,) = unused(docs, "__print")
    kept = docs.join(first, same, "left_semi").withColumn(mark, F.xxhash64(text))
    return kept.dropDuplicates([key, mark]).drop(mark)

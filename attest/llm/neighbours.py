"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Vectors get one more component that makes their lengths equal, so the largest inner product is the smallest angle.
Several rotations, each learned on a bounded sample so that its axes fall between the vectors (iterative
quantisation), give the signs that make up a code. Codes are split into bytes and each byte is indexed. Two codes
within Hamming radius b * (s + 1) - 1 agree in some of their b bytes but for s bits at most, so probing the values
within s of each query byte retrieves every code within that radius. The radius grows until ``RERANKED`` codes of a
shard are within it; those are ranked by their exact inner products.

Copies of a vector are indexed once, with as many of their smallest ids as an answer can hold. Shards of the index meet
blocks of queries; both have a bounded size, whatever the tables have, and each such cell is a task's group of its own:
cells are dealt to several times as many partitions, which are not merged again however few bytes they hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.session import ship_with_plans, written

ship_with_plans(__name__)

NEAREST = 20
#: Vectors the rotations are learned on, at most.
SAMPLE = 5_000
BITS = 256
SHARD = 16_384
BLOCK = 1_024
#: Codes of a shard that are ranked by their vectors, at least.
RERANKED = 800
#: Partitions for each cell, so that few share one, and partitions at most.
CELL_PARTITIONS, MOST_PARTITIONS = 4, 50_000
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
#: The bytes at each distance from each byte.
_NEAR = [[np.flatnonzero(row == s).tolist() for s in range(9)] for row in _DISTANCE]


class Rotations:
    """Centre and rotations of lifted vectors."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, rounds: int = 20, seed: int = 42):
        self.longest = longest
        lifted = self.lift(sample)
        size = lifted.shape[1]
        self.centre = lifted.mean(axis=0)
        rest = lifted - self.centre
        rng = np.random.default_rng(seed)
        self.turns = []
        for _ in range(math.ceil(bits / size)):
            turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
            for _ in range(rounds):
                signs = np.where(rest @ turn > 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ rest)
                turn = (u @ v).T
            self.turns.append(turn)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        return np.hstack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1, keepdims=True), 0))])

    def codes(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        if queries:
            lifted = np.hstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))])
        else:
            lifted = self.lift(vectors)
        return np.packbits(np.hstack([(lifted - self.centre) @ t > 0 for t in self.turns]), axis=1)


class MultiIndex:
    """Codes (rows of bytes) with, for each byte, the codes in the order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.lists = []
        for j, order in enumerate(self.orders):
            edges = np.searchsorted(codes[order, j], np.arange(257)).tolist()
            self.lists.append([order[a:b] for a, b in zip(edges[:-1], edges[1:])])

    def within(self, code: np.ndarray, enough: int) -> tuple[np.ndarray, int]:
        """All codes within the smallest probed radius that holds ``enough`` of them, or all codes; and the radius."""
        bytes_, n = self.codes.shape[1], len(self.codes)
        seen, found, far = np.zeros(n, bool), [], []
        for s in range(9):
            parts = [own[value] for own, byte in zip(self.lists, code.tolist()) for value in _NEAR[byte][s]]
            marked = np.zeros(n, bool)
            marked[np.concatenate(parts)] = True
            new = np.flatnonzero(marked & ~seen)
            seen[new] = True
            found.append(new)
            far.append(np.bitwise_count(self.codes[new] ^ code).sum(axis=1))
            radius = bytes_ * (s + 1) - 1
            ids, distance = np.concatenate(found), np.concatenate(far)
            inside = distance <= radius
            if inside.sum() >= enough or len(ids) == n:
                break
        if len(ids) > enough:
            # The smallest radius with enough codes; all of them are known.
            radius = min(radius, int(np.partition(distance, enough - 1)[enough - 1])) if len(ids) == n or inside.sum() >= enough else radius
            inside = distance <= radius
            return ids[inside], radius
        return ids, radius


def usable(vector: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST,
               sample: int = SAMPLE, bits: int = BITS, shard: int = SHARD, block: int = BLOCK, reranked: int = RERANKED) -> DataFrame:
    """``query_id, rank, key, score``: the ``nearest`` rows found for each query row, by inner product.

    A query's candidates are all rows with another key; nearest first, ties to the smaller key, ranks from 1. Products
    are those of the vectors as they are, in double precision. Vectors that are null, zero, or hold a null or a
    component that is not finite take no part, nor do rows with a null key or a length other than the commonest (ties:
    the longer). Rows that share key and vector are one. Without usable rows or queries there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id {vectors.schema[key].dataType.simpleString()}, rank int, {key} {vectors.schema[key].dataType.simpleString()}, score double")
    rows = rows.where(F.size("v") == common["d"]).groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("h", F.xxhash64("v"))
    first = Window.partitionBy("h", "v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest + 1)
    groups = written(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = rows.where("q").select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("qv"))
    asked = asked.join(groups, (F.col("qh") == groups["h"]) & (F.col("qv") == groups["v"])).select("query_id", F.get("ids", F.lit(0)).alias("g"))
    asked = written(asked, "queries")
    counts = groups.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("longest")).first()
    shards, blocks = math.ceil(counts["n"] / shard), math.ceil(asked.select("g").distinct().count() / block)
    picked = groups.orderBy("h").limit(sample).select("v").collect()
    turned = Rotations(np.array([r["v"] for r in picked]), math.sqrt(counts["longest"]), bits)

    named = groups.withColumn("g", F.get("ids", F.lit(0)))
    index = named.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    wanted = asked.select(F.col("g").alias("of")).distinct()
    again = groups.select(F.get("ids", F.lit(0)).alias("g"), F.col("v").alias("w"))
    queries = again.join(wanted, F.col("g") == F.col("of"), "left_semi").select("g", F.col("w").alias("v"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(max(blocks, 1)))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    schema = f"g {rows.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"

    def search(own: pa.Table, some: pa.Table) -> pa.Table:
        gs, ids, scores = [], [], []
        if len(own) and len(some):
            data, wanted = (np.array(t.column(n).combine_chunks().flatten()).reshape(len(t), -1) for t, n in ((own, "v"), (some, "w")))
            codes = MultiIndex(turned.codes(data))
            held = own.column("ids").to_pylist()
            for g, query, code in zip(some.column("asked").to_pylist(), wanted, turned.codes(wanted, queries=True)):
                near, _ = codes.within(code, max(reranked, nearest + 1))
                product = data[near] @ query
                if len(near) > nearest + 1:
                    last = np.partition(product, len(near) - nearest - 1)[len(near) - nearest - 1]
                    near, product = near[product >= last], product[product >= last]
                answer = sorted((-p, i) for p, x in zip(product.tolist(), near.tolist()) for i in held[x])[: nearest + 1]
                gs += [g] * len(answer)
                ids += [i for _, i in answer]
                scores += [-p for p, _ in answer]
        types = [some.schema.field("asked").type] * 2
        return pa.table([pa.array(gs, types[0]), pa.array(ids, types[1]), pa.array(scores, pa.float64())], ["g", "id", "score"])

    parts = max(CELL_PARTITIONS * shards * max(blocks, 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(parts, MOST_PARTITIONS)
    # Equal numbers of another type would be dealt elsewhere.
    own = index.select(F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"), "v", "ids").repartition(parts, "shard", "block")
    some = queries.select(F.col("shard").cast("long").alias("s"), F.col("block").cast("long").alias("b"), F.col("g").alias("asked"), F.col("v").alias("w"))
    cells = own.groupBy("shard", "block").cogroup(some.repartition(parts, "s", "b").groupBy("s", "b"))
    found = cells.applyInArrow(search, schema)
    best = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= nearest + 1)
    lists = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    # The query itself is one of the first, or the last of them is one too many.
    others = F.expr(f"slice(filter(found, x -> x.id <> query_id), 1, {nearest})")
    out = asked.join(lists, "g").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))

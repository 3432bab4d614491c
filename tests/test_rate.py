"""Leaky buckets: the distributed fold and the stream against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from attest.operators.access import ALL_REQUESTS, MUTATIONS, Bucket, LeakyBuckets, _islands, rate_limit
from attest.streaming.keyed import stream_rate_limit

START_MS = 1_700_000_000_000


def traffic(seed, clients, n, span_ms):
    """Bursts, idle gaps and many requests in one millisecond; client 0 sends a third of everything."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = 0 if rng.random() < 0.34 else rng.randrange(1, clients)
        base = START_MS + rng.choice([0, 0, span_ms // 3, span_ms - 500])
        rows.append((client, base + rng.randrange(0, 40) * rng.choice([0, 1, 50, 900]), i, rng.random() < 0.4))
    return rows


def folded(rows, everything, mutations):
    state, verdict = {}, {}
    for client, ms, i, post in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        bucket = state.setdefault(client, LeakyBuckets(everything, mutations))
        verdict[i] = bucket.admit(ms, post)
    return verdict


def table(spark, rows):
    df = spark.createDataFrame(rows, "client int, ms long, id long, post boolean")
    return df.withColumn("ts", F.timestamp_millis("ms")).repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("buckets", [
    (ALL_REQUESTS, MUTATIONS), (ALL_REQUESTS, None), (Bucket(3, 1000, 2), Bucket(1, 1000, 0)), (Bucket(7, 60_000, 4), Bucket(5, 7_000, 9)),
])
@pytest.mark.parametrize("slice_rows", [60, 1_000_000])
def test_fold_equals_loop(spark, seed, buckets, slice_rows):
    rows = traffic(seed, 12, 1500, 600_000)
    result = rate_limit(table(spark, rows), "client", "ts", "id", *buckets, F.col("post"), slice_rows=slice_rows)
    got = {r["id"]: r["allowed"] for r in result.collect()}
    assert len(got) == len(rows)
    assert got == folded(rows, *buckets)


@pytest.mark.parametrize("buckets", [
    (ALL_REQUESTS, MUTATIONS), (ALL_REQUESTS, None), (Bucket(3, 1000, 2), Bucket(1, 1000, 0)), (Bucket(7, 60_000, 4), Bucket(5, 7_000, 9)),
])
def test_a_client_that_never_pauses_is_folded_in_slices(spark, buckets):
    """Steady traffic far over the budget, mutations only now and then: the same verdicts as one loop, from many slices."""
    rng = random.Random(8)
    cell = max(b.drain_ms() for b in buckets if b)
    rows, ms = [], START_MS
    for i in range(2400):
        ms += rng.choice([0, 1, 1, cell // 120, cell // 40, cell // 14])
        rows.append((0 if rng.random() < 0.8 else rng.randrange(1, 5), ms, i, (ms // (4 * cell)) % 3 == 0 and rng.random() < 0.3))
    df = table(spark, rows)
    result = rate_limit(df, "client", "ts", "id", *buckets, F.col("post"), fold_rows=150)
    got = {r["id"]: r["allowed"] for r in result.collect()}
    assert got == folded(rows, *buckets)
    tick = F.unix_millis("ts")
    tagged = df.withColumns({"__tick": tick, "__cell": F.floor(tick / F.lit(cell)), "__mutation": F.col("post") if buckets[1] else F.lit(False)})
    slices = _islands(tagged, "client", *buckets, 150).where("client = 0 AND __sliced").select("__island", "__slice").distinct()
    assert slices.count() >= 4


def test_verdicts_of_the_buckets():
    bucket = LeakyBuckets(ALL_REQUESTS, MUTATIONS)
    assert [bucket.admit(0, False) for _ in range(23)] == [True] * 21 + [False] * 2
    assert bucket.admit(999, False) is False, "not a whole request has drained"
    assert bucket.admit(1000, False) is True
    mutations = LeakyBuckets(ALL_REQUESTS, MUTATIONS)
    assert [mutations.admit(0, True) for _ in range(8)] == [True] * 6 + [False] * 2
    assert mutations.admit(0, False) is True, "a refused mutation adds no load to the other bucket"


def test_stream_equals_table(spark, tmp_path):
    rows = sorted(traffic(5, 6, 600, 400_000), key=lambda r: (r[1], r[2]))
    source, schema = tmp_path / "in", "client int, ms long, id long, post boolean"
    for start in range(0, len(rows), 150):
        spark.createDataFrame(rows[start:start + 150], schema).coalesce(1).write.mode("append").parquet(str(source))
    ordered = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream = ordered.withColumn("ts", F.timestamp_millis("ms"))
    result = stream_rate_limit(stream, "client", "ts", "id", ALL_REQUESTS, MUTATIONS, F.col("post"))
    handle = result.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    handle.awaitTermination()
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == folded(rows, ALL_REQUESTS, MUTATIONS)

"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from attest.llm.importance import resample, resampled
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"
WORDS = ["alpha", "Beta", "été", "x1", "gamma-ray", "日本", "the", "of", "B"]


def grams(text, orders):
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, orders=1, buckets=10_000, least=20, percent=10):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(bucket(g) for _, t in rows for g in grams(t, orders)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, orders)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    out = []
    for doc, text in rows:
        words, found = grams(text, orders)
        weight = sum(gain[bucket(g)] for g in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = [(*r, i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    return Counter(drawn + [(*r, None) for r in able[len(drawn) :] + [r for r in out if r[1] < least]])


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 3, 25, 60]))) for _ in range(n)]


def found(docs, target, **options):
    return Counter(tuple(r) for r in resampled(docs, target, **options).drop("print").collect())


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_equals_a_plain_loop(spark, orders):
    rows = [(i, t) for i, t in enumerate(texts(1, 300))] + [(900, None), (901, ""), (902, "\x01 ,."), (None, "the of " * 30), (903, "word " * 100_000)]
    aims = [*texts(2, 20), None, ""]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    target = spark.createDataFrame([(t,) for t in aims], "text string")
    options = {"orders": orders, "percent": 30, "buckets": 10_000 if orders == 1 else 97}
    expected = brute(rows, aims, orders, options["buckets"], percent=30)
    assert found(docs, target, **options) == expected


def test_batches_of_several_pieces(spark):
    rows = [(i, t) for i, t in enumerate([*texts(3, 60), *["Alpha of the " * n for n in (150_000, 200_000, 400_000)], *texts(4, 60)])]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert found(docs, spark.createDataFrame([("the alpha",)], "text string")) == brute(rows, ["the alpha"])


def test_repeated_rows_ties_and_clashing_columns(spark):
    rows = [(7, "the of alpha " * 10)] * 40 + [(8, "the")] * 5
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("key", "print", "tag", "buckets", "score", "rank")])
    target = spark.createDataFrame([("the",)], "text string")
    out = resampled(docs, target, percent=25).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 11)) and len(out) == 45
    assert resample(docs, target, percent=25).count() == 40


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert found(docs, target) == Counter()
    rows = [(i, "the of alpha beta " * 6) for i in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA), target) == brute(rows, [])

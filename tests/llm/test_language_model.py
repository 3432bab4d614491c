import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from attest.llm.chunks import pack_sorted, unpack_sorted
from attest.llm.language_model import _Chunk, score_texts


def brute(rows, m=20.0, m3=5.0):
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def held(key):
        return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0

    word, pair, triple = Counter(), Counter(), Counter()
    for key, text in rows:
        if not held(key):
            t = tokens(text)
            word.update(t)
            pair.update(zip(["start", *t[:-1]], t))
            triple.update(zip(["start", *t[:-2]], t[:-1], t[1:]))
    n, v = sum(word.values()), len(word)
    word["start"] = word[None]
    out = []
    for key, text in rows:
        t = tokens(text)
        p = [(word[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        histories = ["start", *t[:-1]]
        q = [(pair[h, w] + m * x) / (word[h] + m) for h, w, x in zip(histories, t, p)]
        for i in range(1, len(t)):
            g, h = t[i - 2] if i > 1 else "start", t[i - 1]
            if pair[g, h] >= 2:
                q[i] = (triple[g, h, t[i]] + m3 * q[i]) / (pair[g, h] + m3)
        out.append((key, held(key), len(t), sum(word[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, q))))
    return out


def check(docs, rows, **options):
    got = sorted((tuple(r) for r in score_texts(docs, **options).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9, abs=1e-9) for w in want]
    return got


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(docs, [(r.doc_id, r.text) for r in docs.collect()], chunk_bytes=60_000)
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, "A b"), (1, None), (2, ""), (3, "a B a b É é"), (3, "a B a b É é"), (10, "a " * 50_000), (8, "new words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS chunk")
    check(docs, rows)
    assert score_texts(docs.limit(0)).count() == 0
    check(docs.where("doc_id = 2 OR doc_id = 8"), rows[2:3] + rows[-1:])


def test_arcs_and_failure_sum_to_one(spark):
    """Over the vocabulary, the end and one unknown word, whatever the history."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b c", "a b d", "b a b", "a b"] * 3) if zlib.crc32(str(i).encode()) % 10]
    held = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 10 == 0]
    for history in ("a b", "b", "d a", ""):
        asked = [(k, f"{history} {w}".strip()) for k, w in zip(held, ["a", "b", "c", "d", "zzz"])] + [(held[9], history)]
        got = {r[0]: r[6] for r in score_texts(spark.createDataFrame(rows + asked, "doc_id long, text string"), buckets=3).collect()}
        want = {r[0]: r[6] for r in brute(rows + asked)}
        assert got == pytest.approx(want)


def test_sorted_hashes_pack():
    rng = np.random.default_rng(1)
    for n, most in ((0, 9), (1, 2**63), (5, 1), (1000, 2**64 - 1), (1000, 300)):
        x = np.sort(rng.integers(0, most, n, np.uint64, endpoint=True))
        got, end = unpack_sorted(b"xx" + pack_sorted(x) + b"yy", 2)
        assert (got == x).all() and end == len(pack_sorted(x)) + 2


def test_memory_of_a_chunk():
    """A worker holds one chunk, and its arrays must not be many times as large as its texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{i}" for i in rng.zipf(1.3, 1000) % 100_000) for _ in range(400)]
    rows = pa.table({"key": pa.array(range(len(texts))), "text": pa.array([t.encode() for t in texts])})
    tracemalloc.start()
    try:
        chunk = _Chunk(rows, 50)
        some, triples = chunk.triples(np.full(len(chunk.pairs.high), 2), 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(some) and len(triples.high) and peak < 24 * sum(map(len, texts))

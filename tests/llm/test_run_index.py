import hashlib
import random

import numpy as np
from attest.llm.run_index import RunIndex, remove_shared, suffix_order


def brute(rows, window=50):
    """For rows with keys that may repeat: (key, bytes, removed, spans, digest), sorted."""
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        rank = -(2**63) if key is None else key
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            first[s] = min(rank, first.get(s, rank))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        rank = -(2**63) if key is None else key
        gone = [False] * len(data)
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < rank:
                gone[i : i + window] = [True] * window
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes_and_streamed_lengths():
    rng = random.Random(1)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))]
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        whole, at = [], 0
        for i, s in enumerate(strings):
            whole += [([*s[j:], 256 + i], at + j) for j in range(len(s))] + [([256 + i], at + len(s))]
            at += len(s) + 1
        whole.sort()
        assert suffix_order(text).tolist() == [p for _, p in whole]
        lengths = RunIndex(text, 50).stream()
        for (x, _), (y, p) in zip(whole, whole[1:]):
            same = next(k for k in range(len(y)) if k >= len(x) or x[k] != y[k])
            assert lengths[p] == same


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in remove_shared(docs, chunk_bytes=60_000).collect()), key=str)
    assert got == brute(rows)


def test_periods_passages_nulls_and_repeated_keys(spark):
    rng = random.Random(6)
    letters = "abcdé ü"
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (46, 50, 51, 120, 400)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passage), "a" * rng.randrange(400), "xy" * rng.randrange(200), "".join(rng.choice(letters) for _ in range(rng.randrange(90)))])
                 for _ in range(rng.randrange(5))]
        rows.append((i * 3 - 50, "".join(parts)))
    rows += [(None, passage[3]), (900, None), (901, ""), (7, passage[4] + "z"), (7, passage[4] + "z"), (7, "q" + passage[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS kept").repartition(3)
    for size in (400, 2_000_000):
        got = sorted((tuple(r) for r in remove_shared(docs, chunk_bytes=size, buckets=3).collect()), key=str)
        assert got == brute(rows)
    assert remove_shared(docs.limit(0)).count() == 0
    long = "".join(chr(97 + (i * i) % 23) for i in range(300_000))
    got = remove_shared(spark.createDataFrame([(1, long), (2, long), (3, long[5:])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0), (2, 300_000, 1), (3, 299_995, 1)]


def test_many_stretches_of_one_piece_are_cut_anew(spark, monkeypatch):
    from attest.llm import run_index

    rng = random.Random(9)
    line = "a very common line that many of the documents have"
    strings = ["".join(rng.choice("abcdef ") for _ in range(40)) + line + "".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(120)]
    strings += [strings[3][5:] + "x" * 9, strings[7][:-20] + "y" * 20, line * 2]
    texts = [s.encode() for s in strings]
    rank, name = np.arange(len(texts)) // 2, np.zeros(len(texts), np.uint64)
    size = np.array([len(t) for t in texts])
    stretches = run_index._Stretches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, rank, name)
    whole = stretches.compared(50, 20)
    monkeypatch.setattr(run_index, "INDEX_BYTES", 400)
    cut = stretches.compared(50, 20)
    first = {}
    for s, r in zip(texts, rank.tolist()):
        for i in range(len(s) - 49):
            first[s[i : i + 50]] = min(r, first.get(s[i : i + 50], r))
    want = [first[s[i : i + 50]] < r for s, r in zip(texts, rank.tolist()) for i in range(len(s) - 49)]
    assert whole.tolist() == cut.tolist() == want

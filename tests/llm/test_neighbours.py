import numpy as np
import pandas as pd
from attest.llm.neighbours import MultiIndex, Rotations, neighbours
from pyspark.sql import functions as F


def brute(rows, k=20):
    """Usable rows with different ids: {query: [(id, score), ...]}"""
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, data):
        if i % 20 == 0:
            score = data @ v
            order = [x for x in np.lexsort((ids, -score)) if ids[x] != i][:k]
            out[int(i)] = [(int(ids[x]), float(score[x])) for x in order]
    return out


def search(frame, **options):
    out = {}
    for r in sorted(neighbours(frame, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 8, (500, 4)) * (rng.random((500, 4)) < 0.4)).astype(np.uint8)
    index = MultiIndex(codes)
    for code in codes[:40]:
        ids, radius = index.within(code, 60)
        far = np.bitwise_count(codes ^ code).sum(axis=1)
        assert len(ids) >= 60 and set(ids.tolist()) == set(np.flatnonzero(far <= radius).tolist())


def test_recall_on_a_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    got = search(frame)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q] if i in exact[q])


def test_lengths_copies_ties_and_small_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    same = rows[7][1]
    rows += [(i, same) for i in range(1000, 1100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS g").repartition(3)
    want = brute(rows)
    got = search(frame, shard=100, block=7, reranked=10_000)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0]), (8, []), (None, [1.0, 1.0]), (20, [0.5, -1.0]), (40, [0.0, -0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert search(frame) == {0: [(1, 2.0), (20, 0.5)], 20: [(0, 0.5), (1, 0.0)]}
    assert search(frame.limit(0)) == {} and search(frame.where("vec_id % 20 <> 0")) == {}
    assert Rotations(np.ones((1, 2)), 2.0).codes(np.ones((1, 2))).shape == (1, 33)


def test_recall_on_several_full_shards_as_used(spark):
    """The production setting on vectors of the given table's kind, several shards of them and several blocks of queries."""
    known = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    data = np.stack(known["embedding"].to_numpy()).astype(float)
    rng = np.random.default_rng(4)
    spread = np.linalg.cholesky(np.cov(data.T) + 1e-9 * np.eye(data.shape[1]))
    rows = data.mean(axis=0) + rng.normal(size=(24_000, data.shape[1])) @ spread.T
    rows[:4_000] = data[rng.integers(0, len(data), 4_000)] + 0.05 * rng.normal(size=(4_000, data.shape[1]))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(rows)), "embedding": list(rows)}))
    got = search(frame)
    hits, queries = 0, [q for q in sorted(got)]
    assert queries == list(range(0, len(rows), 20))
    for q in queries:
        score = rows @ rows[q]
        score[q] = -np.inf
        hits += len(set(np.argpartition(-score, 20)[:20].tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 20 * len(queries)
    assert all(abs(s - rows[q] @ rows[i]) < 1e-9 for q in queries[:50] for i, s in got[q])

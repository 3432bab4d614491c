import random
import re
from collections import Counter

from attest.llm.mixing import Mix, mixed, permuted

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return target


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 10, 1000, 4097):
        rows = spark.range(n).selectExpr("id AS i", f"{n}L AS n").select(permuted("i", "n", "7, 1L, 2L").alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))
        assert n < 100 or sum(r.x == i for i, r in enumerate(rows)) < 12


def test_targets_and_takes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, source, n in plain:
        sizes[source] += n
    expected = brute_targets(sizes)
    runs = [Mix(d, lane_words=500).taken().collect() for d in (docs, docs.repartition(3))]
    for rows in runs:
        assert sorted((r.key, r.source, r.size) for r in rows) == sorted(plain)
        assert all(0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] for r in rows)
        assert all(abs(r.target - expected[r.source]) < 1e-6 for r in rows)
        for source in sizes:
            assert abs(sum(r.taken for r in rows if r.source == source) - expected[source]) <= 0.02 * expected[source] + 32
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))


def test_slots_join_whole_blocks_to_their_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randrange(90))), rng.choice(["a", "b", None])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(docs, with_text=True, block_words=8, lane_words=300)
    slots = mix.slots().collect()
    assert sorted(s.shard * 1024 + s.slot for s in slots) == list(range(len(slots)))
    used = Counter((s.sid, s.block) for s in slots)
    assert max(used.values()) <= 2
    words = Counter(w for s in slots for p in s.pieces for w in p.words)
    assert max(words.values()) <= 2 and all(len(p.words) == p.n for s in slots for p in s.pieces)
    took = Counter()
    for w, n in words.items():
        took[int(w[1:].split("w")[0])] += n
    assert {r.key: r.taken for r in mix.taken().collect()} == {i: took[i] for i, _, _ in rows}


def test_nulls_ties_long_and_empty(spark):
    rows = [(1, None, "a", 1), (1, "x y", "a", 2), (1, "x y", "a", 2), (None, "z", None, 3), (2, "", "only empty", 4),
            (3, "w " * 70_000, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").selectExpr("*", "1 AS sid", "2 AS lane")
    got = Mix(docs).taken().collect()
    assert sorted(((r.key, r.size) for r in got), key=str) == sorted([(1, 0), (1, 2), (1, 2), (None, 1), (2, 0), (3, 70_000)], key=str)
    assert all(r.taken <= 2 * r.size for r in got)
    assert Mix(docs.limit(0)).taken().count() == 0


def test_the_mix_is_that_of_the_rows(spark, sf_dir):
    """Other files, other partitions, repeated rows, a hot row, columns that clash: the same documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS __row", "2 AS __words", "3 AS __SPANS", "4 AS tag", "5 AS copy")
    hot = docs.limit(1).selectExpr("explode(sequence(1, 300)) AS i", "*").drop("i").unionByName(docs.limit(3).withColumn("lang", F.lit("other")))
    docs = docs.unionByName(hot).unionByName(docs.where("doc_id < 20"))
    runs = [Counter(map(tuple, mixed(d, block_words=64, lane_words=3000).collect())) for d in (docs, docs.repartition(3), docs.repartitionByRange(5, "text"))]
    assert runs[0] == runs[1] == runs[2]
    assert mixed(docs).columns == docs.columns

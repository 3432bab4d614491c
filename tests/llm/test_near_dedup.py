import random

import numpy as np
import xxhash
from attest.llm.components import components
from attest.llm.near_dedup import covering_masks, linked, near_duplicates, near_links, simhash


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius=3):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def test_every_pair_within_the_radius_meets_in_some_table():
    masks = covering_masks(list(range(64)))
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_join_the_same_components_with_any_bucket(spark):
    rng = random.Random(2)
    codes = set()
    for _ in range(12):
        code = rng.getrandbits(64)
        for _ in range(40):
            codes.add(code)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                code ^= 1 << b
    codes |= {0, 1, 2**63, 2**64 - 1}
    expected = {c: r for c, r in brute_components(codes).items() if c != r}
    table = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    classes = {frozenset(c for c in expected if expected[c] == r) | {r} for r in set(expected.values())}
    for bucket in (3, 4096):
        found = {}
        for row in components(near_links(table, bucket=bucket)).collect():
            found.setdefault(row.root, {row.root}).add(row.node)
        assert {frozenset(c % 2**64 for c in members) for members in found.values()} == classes
    a, b = linked(np.array(sorted(codes), np.uint64), 3)
    assert {int(x): int(y) for x, y in zip(a, b)} == expected


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_simhash(r.text) for r in docs}
    roots = brute_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(got) == len(docs)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == least[roots[prints[r.doc_id]]] for r in got)


def test_nulls_ties_empty_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", None), (None, " \t", "y"), (4, "a b", "z"), (4, "a b", "z"), (None, "only here known by no one", "q"),
            (9, "É é ünï", None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(1, 1), (2, 1), (None, 1), (4, 4), (4, 4), (None, None), (9, 9)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = ("word%d " * 1 % 7) * 60_000
    assert simhash(long.encode()) == brute_simhash(long)

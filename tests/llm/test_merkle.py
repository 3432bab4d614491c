"""The manifest against a tree built with a plain loop."""

import hashlib
import random

import pytest
from attest.llm.merkle import FIELDS, folded, manifest, path_digest, ranked, tampered
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(level, fanout):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // fanout * fanout
            path.append((level[run : at[i]], level[at[i] + 1 : run + fanout]))
            at[i] //= fanout
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout=3):
    """(doc_id, source, pos, leaf, subroot, root, digest of the siblings), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((-(1 << 63) if r[0] is None else r[0], sha(*map(encoded, r)), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])], fanout) for s in order}
    root, above = tree([trees[s][0] for s in order], fanout) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for pos, (_, leaf, doc) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            path = trees[s][1][pos] + above[k]
            out.append((doc, s, pos, leaf, trees[s][0], root, sha(*[h for b, a in path for h in b + a])))
    return sorted(out, key=str)


def found(docs, **options):
    out = manifest(docs, **options)
    rows = out.select("doc_id", "source", "pos", "leaf", "subroot", "root", path_digest(F.col("path"))).collect()
    return sorted(map(tuple, rows), key=str)


def some_rows(seed, ids, sources):
    rng = random.Random(seed)
    text = [None, "", "a\nb", "long " * 5000, "é\n\n", "x"]
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(text)) for i in ids]


@pytest.mark.parametrize(("ids", "sources"), [
    (range(900), ["a"]),
    ([i * 1_000_003_000_007 - 2**60 for i in range(300)], ["a", "B", "é", "", None]),
    ([5, 5, 5, -1, None, None, 7, 2**63 - 1, -(2**63)] * 3, ["a", None]),
    ([1], [None]),
    (range(40), [f"s{i}" for i in range(30)]),
])
def test_equals_a_plain_loop(spark, ids, sources):
    rows = some_rows(1, ids, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs) == brute(rows)


def test_other_fan_out(spark):
    rows = some_rows(2, range(130), ["a", "b", "c"])
    assert found(spark.createDataFrame(rows, SCHEMA), fanout=2) == brute(rows, 2)


def test_repeated_rows_and_clashing_columns(spark):
    rows = some_rows(3, [1, 2, 3], ["a"]) * 50
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("group", "pos", "leaf", "tag", "__w", "digest", "path")])
    assert found(docs) == brute(rows)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_tampering_is_found(spark):
    rows = some_rows(4, range(200), ["a", "b"])
    out = manifest(spark.createDataFrame(rows, SCHEMA), also={"tampered": tampered()})
    fold = folded(F.coalesce("tampered", "leaf"), F.col("path")) == F.col("root")
    honest = folded(F.col("leaf"), F.col("path")) == F.col("root")
    texts = {r[0]: r[4] for r in rows}
    changed = 0
    for r in out.select("doc_id", "tampered", fold.alias("same"), honest.alias("honest")).collect():
        assert r.honest and r.same == (r.tampered is None)
        assert r.tampered is None or "\n" in texts[r.doc_id]
        changed += not r.same
    assert 0 < changed < sum("\n" in (t or "") for t in texts.values())
    assert list(FIELDS) == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_ranks_count_repeats(spark):
    ids = [3, 3, 3, 64, 65, 1 << 40, -7, -7, 1 << 62]
    rows, _, repeats = ranked(spark.createDataFrame([("g", i) for i in ids], "g string, i long"), ["g"], "i", "r")
    assert repeats
    assert sorted((r.i, r.r) for r in rows.collect()) == sorted((i, sum(x < i for x in ids)) for i in ids)

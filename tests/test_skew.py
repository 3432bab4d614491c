"""Sliced and plain plans give the same rows, checked against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attest.operators.access import code_outcomes, lookup_owned, session_state
from attest.operators.digests import checksum_listing, verify_digests
from attest.operators.graph import resolve_edges
from attest.operators.reconcile import changed_only, reconcile_links, verify_targets
from attest.operators.runs import effective_release, mark_superseded
from attest.operators.sets import in_order
from attest.operators.skew import OrderedScan, hot_keys, lookup_join, with_ordinal

SMALL = 40  # rows per slice: the hot key of these fixtures spans many slices


def skewed_rows(seed=1, n=1200):
    """A third of the rows belong to one key, another part has no key; times repeat, ids do not."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else None if rng.random() < 0.1 else rng.randint(1, 30)
        rows.append((key, rng.randint(0, 150), i, rng.choice(["a", "a", "b", None])))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), "k int, ts long, id long, v string").repartition(5)


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


def test_hot_keys_are_those_over_the_limit(spark, skewed):
    hot = {r["__key"]: r["__rows"] for r in hot_keys(skewed, ["k"], SMALL).collect()}
    counts = Counter(r[0] for r in skewed_rows())
    hashes = spark.createDataFrame([(k,) for k in counts], "k int").select("k", F.xxhash64("k").alias("h")).collect()
    assert hot == {r["h"]: counts[r["k"]] for r in hashes if counts[r["k"]] > SMALL}
    assert hot_keys(skewed, ["k"], 10_000).count() == 0


def test_a_thin_sample_finds_the_heavy_key(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") < 100_000, 0).otherwise(F.col("id")).alias("k"))
    found = hot_keys(rows, ["k"], 10_000).collect()
    assert len(found) == 1 and 80_000 < found[0]["__rows"] < 120_000


@pytest.mark.parametrize("slice_rows", [7, SMALL, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(skewed, slice_rows, inclusive):
    scan = OrderedScan(skewed, ["k"], ["ts", "id"], slice_rows)
    assert scan.sliced == (slice_rows < 10_000)
    result = scan.running(
        last={"seen": F.col("v")}, total={"n": F.when(F.col("v") == "a", 1).otherwise(0)}, inclusive=inclusive
    ).result()
    expected = Counter()
    for rows in by_key(skewed_rows()).values():
        seen, n = None, 0
        for r in rows:
            before = (seen, n)
            seen, n = r[3] or seen, n + (r[3] == "a")
            expected[(*r, *((seen, n) if inclusive else before))] += 1
    assert collected(result.select("k", "ts", "id", "v", "seen", "n")) == expected


def test_scans_can_build_on_each_other(skewed):
    def run(slice_rows):
        scan = OrderedScan(skewed, ["k"], ["ts", "id"], slice_rows).running(total={"n": F.lit(1)})
        mark = F.when(F.col("v") == "b", F.struct("n", "ts"))
        return collected(scan.running(last={"at": mark}).result().select("id", "n", "at.n", "at.ts"))

    assert run(SMALL) == run(10_000)


def test_ordinal_is_the_position_in_the_group(skewed):
    result = {r["id"]: r["ordinal"] for r in with_ordinal(skewed, ["k"], ["ts", "id"], slice_rows=SMALL).collect()}
    for rows in by_key(skewed_rows()).values():
        assert [result[r[2]] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("distinct_by", [None, ["id"]])
def test_lookup_join_equals_plain_join(spark, skewed, how, distinct_by):
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 25)], "k int, name string")
    sliced = lookup_join(skewed, table, ["k"], how, SMALL, distinct_by)
    assert collected(sliced.select("k", "id", "name")) == collected(skewed.join(table, "k", how).select("k", "id", "name"))


def test_lookup_join_keeps_exact_copies(spark):
    rows = spark.range(500).select(F.lit(1).alias("k"), F.lit("x").alias("v")).unionByName(
        spark.range(30).select(F.col("id").cast("int").alias("k"), F.lit("y").alias("v"))
    )
    table = spark.createDataFrame([(1, "one")], "k int, name string")
    result = lookup_join(rows, table, ["k"], "left", 60).groupBy("k", "v", "name").count()
    assert collected(result.where("count > 1")) == Counter({(1, "x", "one", 500): 1})
    assert result.count() == 31


def test_operators_do_not_depend_on_slicing(spark, skewed):
    rows = skewed.where("k is not null")
    issued, submitted = rows.where("v = 'b'"), rows.where("v = 'a'")
    timed = lambda d: d.withColumn("ts", F.timestamp_seconds(F.col("ts") * 100))
    table = spark.createDataFrame([(k, k) for k in range(20)], "k int, w int")
    edges = table.select(F.col("k").alias("node"))
    cases = {
        "superseded": lambda s: mark_superseded(rows, ["k"], "id", s),
        "effective": lambda s: effective_release(rows, ["k"], ["ts", "id"], "id", F.col("v") == "a", s),
        "changed": lambda s: changed_only(rows, ["k"], ["ts", "id"], ["v"], s),
        "codes": lambda s: code_outcomes(timed(issued), timed(submitted), "k", "ts", "id", "v", 900, 2, s),
        "sessions": lambda s: session_state(timed(rows), "k", "ts", "id", F.col("v") == "a", F.col("v") == "b", 700, s),
        "edges": lambda s: resolve_edges(rows, edges, "k", "node", s),
        "owned": lambda s: lookup_owned(table.withColumn("o", F.lit("a")), rows.withColumnRenamed("v", "o"), "k", "o", ["w"], s),
        "digests": lambda s: verify_digests(
            rows.select("k", "id", F.col("ts").alias("size"), F.col("v").alias("sha256")),
            table.select("k", F.lit(5).cast("bigint").alias("size"), F.lit("a").alias("sha256")), ["k"], s),
        "targets": lambda s: verify_targets(
            rows.select("id", F.col("k").cast("string").alias("ref"), F.col("v").alias("tag")),
            table.select(F.col("k").cast("string").alias("id")),
            spark.createDataFrame([("a", "0", None), ("x", None, "1")], "name string, commit_id string, target string"), s),
        "links": lambda s: reconcile_links(
            rows.select("k", F.col("id").alias("name"), F.col("ts").alias("url"), F.col("v").alias("path")),
            rows.where("ts < 100").select("k", F.col("id").alias("name"), F.when(F.col("k") == 3, 0).otherwise(F.col("ts")).alias("url"),
                                          F.lit("a").alias("path"), "id", F.col("id").alias("position")), "k", "name", "position", s),
        "numbered": lambda s: in_order(rows, ["ts", "id"], "position"),
        "listing": lambda s: checksum_listing(rows, ["k"], ["ts", "id"], "id", "v", 9, s),
    }
    for name, case in cases.items():
        plain, sliced = case(100_000), case(SMALL)
        assert plain.columns == sliced.columns, name
        assert collected(plain) == collected(sliced), name


def test_listing_blocks_concatenate_to_the_whole(spark, skewed):
    rows = skewed.where("k is not null").na.fill("-")
    blocks = checksum_listing(rows, ["k"], ["ts", "id"], "id", "v", block_lines=9, slice_rows=SMALL).collect()
    text = defaultdict(dict)
    for r in blocks:
        text[r["k"]][r["block"]] = r["text"]
        assert r["n_lines"] == r["text"].count("\n") <= 9
    for k, group in by_key(skewed_rows()).items():
        if k is not None:
            whole = "".join(f"{r[3] or '-'}  {r[2]}\n" for r in group)
            assert "".join(text[k][b] for b in sorted(text[k])) == whole

"""Table-driven lookups and range digests against plain loops."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from attest.operators.lookup import address_hex, longest_prefix, lookup_range, match_route_table, outside_table, range_blocks, refused_ranges
from attest.operators.sets import differing_ranges, same_rows, same_rows_by_range


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def narrowest(address, ranges):
    try:
        a = ipaddress.ip_address(address)
    except (ValueError, TypeError):
        return None
    held = []
    for cidr, name in ranges:
        try:
            n = ipaddress.ip_network(cidr, strict=False)
        except (ValueError, TypeError):
            continue
        if n.version == a.version and n.prefixlen and a in n:
            held.append((-n.prefixlen, name, cidr))
    return min(held)[1:] if held else None


@pytest.mark.parametrize("slice_rows", [20, 1_000_000])
def test_narrowest_range(spark, slice_rows):
    rng = random.Random(1)
    base = [rng.randrange(2**32) for _ in range(40)]
    wide = [rng.randrange(2**128) for _ in range(20)]
    ranges = [(f"{ipaddress.ip_address(rng.choice(base))}/{rng.randrange(0, 33)}", f"n{i}") for i in range(300)]
    ranges += [(f"{ipaddress.ip_address(rng.choice(wide))}/{rng.randrange(0, 129)}", f"w{i}") for i in range(200)]
    ranges += [("10.0.0.0/8", "b"), ("10.0.0.0/8", "a"), ("10.1.0.0/16", "in"), ("bad", "x"), (None, "y"), ("1.2.3.4/33", "z"), ("::/0", "all"), ("1.2.3/8", "short")]
    addresses = [str(ipaddress.ip_address(b ^ rng.randrange(2 ** rng.randrange(1, 32)))) for b in base for _ in range(5)]
    addresses += [str(ipaddress.ip_address(b ^ rng.randrange(2 ** rng.randrange(1, 127)))) for b in wide for _ in range(5)]
    addresses += ["10.1.2.3", "10.2.0.0", "nothing", None, "", "1.2.3.4.5"] + ["10.1.2.3"] * 100
    table = spark.createDataFrame(ranges, "cidr string, name string")
    df = spark.createDataFrame(list(enumerate(addresses)), "id int, address string").repartition(3)
    out = lookup_range(df, "address", table, slice_rows=slice_rows)
    assert not re.search("NestedLoop|Cartesian", plan(out))
    got = {r["id"]: (r["name"], r["range"]) if r["name"] else None for r in out.collect()}
    assert got == {i: narrowest(a, ranges) for i, a in enumerate(addresses)}
    refused = {r["name"] for r in refused_ranges(table).collect()}
    assert {"x", "y", "z", "all", "short"} <= refused and "a" not in refused


def test_blocks_of_any_range(spark):
    rng = random.Random(2)
    rows = [("0.0.0.0", "255.255.255.255"), ("0.0.0.5", "0.0.0.4"), ("1.1.1.1", "1.1.1.1"), (None, "1.1.1.1")]
    for _ in range(80):
        a = rng.randrange(2**32)
        rows.append(tuple(str(ipaddress.ip_address(x)) for x in (a, min(2**32 - 1, a + rng.choice([1, 6, 255, 100_000, 2**30])))))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", range_blocks("a", "b").alias("x")).collect()
    for r in got:
        ends = [ipaddress.ip_address(x) if x else None for x in (r["a"], r["b"])]
        want = [str(n) for n in ipaddress.summarize_address_range(*ends)] if None not in ends and ends[0] <= ends[1] else []
        assert (r["x"] or []) == want


def test_addresses_in_digits(spark):
    texts = ["1.2.3.4", "::1", "FE80::1:0", "::ffff:1.2.3.4", "1.2.3", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").select(address_hex("a")).collect()]
    assert got == ["01020304", "0" * 31 + "1", "fe80" + "0" * 20 + "00010000", "0" * 20 + "ffff01020304", None, None, None]


@pytest.mark.parametrize("slice_rows", [20, 1_000_000])
def test_routes_and_allow_lists(spark, slice_rows):
    rng = random.Random(3)
    parts = ["a", "ab", "b", "é", "日本", ""]
    paths = ["/" + "/".join(rng.choices(parts, k=rng.randrange(5))) for _ in range(200)] + ["/a/b"] * 80 + [None, ""]
    routes = [(p[: rng.randrange(len(p) + 1)], rng.random() < 0.2, f"r{i}") for i, p in enumerate(rng.choices(paths[:200], k=60))] + [(None, False, "none"), (None, True, "none")]

    def expected(path):
        if path is None:
            return None
        exact = [b for r, e, b in routes if e and r == path]
        below = [(-len(r), b) for r, e, b in routes if not e and r is not None and path.startswith(r)]
        return min(exact) if exact else min(below)[1] if below else None

    table = spark.createDataFrame(routes, "route string, exact boolean, backend string")
    df = spark.createDataFrame(list(enumerate(paths)), "id int, path string").repartition(3)
    out = match_route_table(df, "path", table, slice_rows)
    assert not re.search("NestedLoop|Cartesian", plan(out))
    assert {r["id"]: r["backend"] for r in out.collect()} == {i: expected(p) for i, p in enumerate(paths)}
    outside = outside_table(df, "path", table, r"b\z", slice_rows).collect()
    want = {i: "forbidden" if p and p.endswith("b") else "unexpected" for i, p in enumerate(paths) if (p and p.endswith("b")) or expected(p) is None}
    assert {r["id"]: r["reason"] for r in outside} == want
    empty = longest_prefix(df, "path", spark.createDataFrame([], "prefix string, name string"))
    assert empty.where("name IS NOT NULL").count() == 0 and empty.count() == len(paths)


def test_ranges_that_differ(spark, tmp_path):
    rows = spark.range(0, 50_000).selectExpr("id * 7 - 1000 AS k", "id % 13 AS v", "if(id % 11 = 0, null, cast(id AS string)) AS s")
    rows.repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    assert differing_ranges(a, a, "k") == []
    b = a.withColumn("v", F.when(F.col("k") == 6_994, 99).otherwise(F.col("v"))).where("k <> 20000").unionByName(a.where("k = 90000"))
    b = b.unionByName(spark.createDataFrame([(10**12, 1, "far"), (None, 2, "null")], b.schema))
    ranges = differing_ranges(a, b, "k", fanout=16, leaf_rows=100)
    held = a.where(" OR ".join(f"k BETWEEN {low} AND {high}" for low, high in ranges))
    assert 0 < held.count() < 1_000 and all(any(low <= k <= high for low, high in ranges) for k in (6_994, 20_000, 90_000, 10**12))
    out = same_rows_by_range(a, b, "k", fanout=16, leaf_rows=100)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, same_rows(a, b).collect()), key=str)
    assert "GreaterThanOrEqual(k" in plan(out)
    many = a.withColumn("v", F.col("v") + 1)
    assert same_rows_by_range(a, many, "k", most_ranges=10).count() == 2 * a.count()
    none = a.where("k > 10000000")
    assert differing_ranges(none, none, "k") == [] and same_rows_by_range(none, a, "k").count() == a.count()

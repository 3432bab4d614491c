"""Checked publication: digests packed in shuffles, shares of keys, and the disk that its steps leave."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from attest.functions.content import packed, packed_hex, unpacked
from attest.functions.predicates import is_hex
from attest.plans.release import checked_publication, publication_plan, release_check
from attest.session import SHUFFLE_CLEANUP, written, written_by_share

A, B, C = "a" * 64, "b" * 64, "C" * 64
SHA = "d" * 40


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}


def tables(spark, release="long"):
    """Files that are there, gone, changed, too large, named twice or badly; keys that are null or come twice."""
    ids = [*range(40), None]
    manifests = [(r, f"1.{r}.0", f"v1.{r}.0", SHA, SHA) for r in ids] + [(99, "1.99.0", "v1.99.0", SHA, SHA), (5, "1.5.0", "v1.5.0", SHA, SHA)]
    files = [(r, f"{r}/{n}", n, A) for r in ids for n in ("a", "b", "c")]
    files += [(1, "1/a", "a", A), (2, "2/x", "../x", A), (3, "3/u", "u", C), (4, None, "n", A), (6, "6/short", "short", "ab"), (7, "7/none", "none", None)]
    actual = [(p, s, 1) for _, p, _, s in files if p not in ("8/a", "9/b", None)] + [("10/a", B, 1), ("11/a", A, 1), ("12/a", A, 1 << 40), (None, A, 1)]
    remote = [(r, "a", None if r % 3 else A, A if r % 2 else B) for r in range(20)] + [(21, "a", "", None), (22, "a", C, A), (22, "b", None, C), (None, "a", A, A)]
    links = [(r, n, f"https://f/{r}/{n}" if r != 23 else "elsewhere", p, i, 1) for r in range(15, 30) for n, p, i in (("a", "/a", 1), ("b", "/old", None))]
    make = spark.createDataFrame
    return {
        "manifests": make(manifests, f"release {release}, version string, tag string, ref string, client_sha string"),
        "files": make(files, f"release {release}, path string, name string, sha256 string"),
        "actual": make(actual, "path string, sha256 string, size long"),
        "commits": make([(SHA,)], "id string"),
        "tags": make([("v1.30.0", None, "moved"), ("v1.31.0", SHA, "")], "name string, commit_id string, target string"),
        "remote": make(remote, f"release {release}, name string, declared_sha256 string, computed_sha256 string"),
        "links": make(links, f"release {release}, name string, url string, path string, id long, position long"),
    }


def test_packed_digests_are_the_texts(spark):
    texts = [(None,), ("",), (A,), (C,), ("ab",), ("AB",), ("abc",), ("zz",), ("\0",), ("é\n",), (A + "\n",), ("a" * 63,), ("a" * 66,), ("0" * 64,)]
    df = spark.createDataFrame(texts, "t string").select("t", packed("t").alias("p")).repartition(3, "p")
    got = df.select("t", unpacked("p").alias("u"), F.octet_length("p").alias("n"), packed_hex("p", 64).alias("h"), is_hex("t", 64).alias("w")).collect()
    assert all(r["t"] == r["u"] and r["h"] == r["w"] for r in got) and len(got) == len(texts)
    assert {r["n"] for r in got if r["w"]} == {33} and all(r["n"] > 0 for r in got if r["t"] is not None)
    assert df.select("p").distinct().count() == len({t for t, in texts})


def test_what_is_wrong_is_shown_as_it_is(spark):
    t = tables(spark)
    got = rows(release_check(t["manifests"], t["files"], t["actual"]).where("release IN (3, 6, 7, 8, 10, 12, 99)"))
    assert got == Counter({
        (3, "u", "sha256", C): 1, (6, "short", "sha256", "ab"): 1, (7, "none", "sha256", None): 1, (8, "a", "missing", None): 1,
        (10, "a", "digest_mismatch", B): 1, (12, "a", "size", str(1 << 40)): 1, (99, None, "no_files", None): 1})


@pytest.mark.parametrize("release", ["long", "int", "string", "double"])
def test_shares_give_the_rows_of_the_whole(spark, release):
    t = tables(spark) if release == "long" else {
        n: d.withColumn("release", F.col("release").cast(release)) if "release" in d.columns else d for n, d in tables(spark).items()}
    whole = checked_publication(**t, address_prefix="https://f/", path_shares=1, release_shares=1)
    dealt = checked_publication(**t, address_prefix="https://f/", path_shares=3, release_shares=4)
    for name, df in whole.items():
        assert rows(dealt[name]) == rows(df) and dealt[name].columns == df.columns, name
    assert {r[0] for r in dealt["uploads"].select("action").collect()} == {"upload", "skip", "conflict"}


def test_uploads_show_every_digest(spark):
    t = tables(spark)
    plan = publication_plan(t["manifests"].select("release", "ref", "tag"), t["commits"], t["tags"], t["files"].select("release", "name", "sha256"),
                            t["remote"], t["links"], "https://f/", shares=2)
    got = rows(plan["uploads"].where("release IN (1, 3, 7, 20, 21, 22) AND name != 'c'"))
    assert got == Counter({
        (1, "a", A, None, A, "skip"): 2, (1, "b", A, None, None, "upload"): 1, (3, "a", A, A, A, "skip"): 1, (3, "b", A, None, None, "upload"): 1,
        (3, "u", C, None, None, "upload"): 1, (7, "a", A, None, A, "skip"): 1, (7, "b", A, None, None, "upload"): 1, (7, "none", None, None, None, "upload"): 1,
        (20, "a", A, None, None, "upload"): 1, (20, "b", A, None, None, "upload"): 1, (21, "a", A, "", None, "conflict"): 1,
        (21, "b", A, None, None, "upload"): 1, (22, "a", A, C, A, "skip"): 1, (22, "b", A, None, C, "conflict"): 1})


def test_keys_of_other_types_meet_in_one_share(spark):
    left = spark.range(100).selectExpr("id AS k", "id AS v")
    for kind in ("int", "double", "string"):
        right = spark.range(100).selectExpr(f"CAST(id AS {kind}) AS k", "id AS w")
        assert written_by_share(lambda a, b: a.join(b, "k"), [left, right], ["k"], 4, "met").count() == 100


def test_steps_of_a_publication_leave_no_shuffles(spark):
    t = tables(spark)
    t["files"] = t["files"].repartition(8)  # a shuffle at least, however small the tables
    before, there = spark.conf.get(SHUFFLE_CLEANUP), shuffle_files(spark)
    checked_publication(**t, address_prefix="https://f/")
    assert not shuffle_files(spark) - there
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    written(spark.range(1000).repartition(4), "kept")
    assert shuffle_files(spark) - there

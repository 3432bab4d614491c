"""Shapes of physical plans that must hold at any size."""

import re

import pytest

from attest.plans.release import publication_plan
from attest.queries import QUERIES

BATCH = [name for name in QUERIES if not name.startswith("stream_")]
PROJECTIONS = [
    "is_hex", "is_safe_name", "check_origin", "field_rule", "classify_path", "parse_change_title", "redact", "map_run_state",
    "describe_run", "digest", "extract_code", "first_line", "rewrite_path", "check", "first_failure", "split_valid", "conform",
    "deploy_check", "parse_records", "in_cidr", "route", "match_route", "lookup_context", "outside_allowlist", "eligible_runs",
    "search_catalog", "fetch_receipt",
]


def plan(spark, sf_dir, name):
    return QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_join_and_no_python_but_the_fold(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", text)
    assert name == "rate_limit" or not re.search("Python|InPandas|ArrowEval", text)


@pytest.mark.parametrize("name", PROJECTIONS)
def test_row_rules_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(spark, sf_dir, name)


def test_requests_are_limited_before_the_shuffle(spark, sf_dir):
    assert re.search(r"WindowGroupLimit .* Partial", plan(spark, sf_dir, "rate_limit"))


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, sf_dir, "digest")
    assert "EqualTo(o_custkey,42)" in plan(spark, sf_dir, "owned")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan(spark, sf_dir, "duplicates")


@pytest.mark.parametrize("name, exchanges", [("effective_release", 1), ("changed_only", 1), ("group_rules", 1), ("report_gate", 1),
                                             ("readiness", 1), ("fold_captures", 1), ("request_counts", 1), ("code_outcomes", 1)])
def test_one_shuffle_is_enough(spark, sf_dir, name, exchanges):
    assert len(re.findall(r"\bExchange hashpartitioning", plan(spark, sf_dir, name))) == exchanges


def test_publication_packs_what_it_writes(spark):
    one = "1" * 64
    releases = spark.createDataFrame([(1, "c", "v1"), (2, "gone", "v2")], "release long, ref string, tag string")
    commits, tags = spark.createDataFrame([("c",)], "id string"), spark.createDataFrame([], "name string, commit_id string, target string")
    files = spark.createDataFrame([(1, "a", one), (2, "a", one)], "release long, name string, sha256 string")
    remote = spark.createDataFrame([(1, "a", None, one)], "release long, name string, declared_sha256 string, computed_sha256 string")
    links = spark.createDataFrame([(1, "a", "https://x/1/a", "/b", 7, 0)], "release long, name string, url string, path string, id long, position long")
    plan = publication_plan(releases, commits, tags, files, remote, links, "https://x/")
    assert [tuple(r) for r in plan["uploads"].select("release", "name", "action").collect()] == [(1, "a", "skip")]
    assert [tuple(r) for r in plan["links"].collect()] == [(1, "a", "https://x/1/a", "/a", 7, "update_path")]
    assert all(".zstd." in f for name in ("uploads", "targets") for f in plan[name].inputFiles())

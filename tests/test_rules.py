"""Rule engine and composite checks on small cases, and their invariants on the test tables."""

from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.operators.assets import extract_assets
from attest.operators.digests import plan_uploads
from attest.operators.graph import expect_matrix, fold_captures, match_by_suffix
from attest.operators.reconcile import current_options, match_pins, option_drift, reconcile_links
from attest.operators.rules import Rule, check, first_failure, split_valid
from attest.operators.runs import classify_runs, effective_release, gate_for, latest_gate, mark_superseded
from attest.operators.sets import group_rules, readiness, report_gate
from attest.plans.deploy import deploy_check
from attest.plans.identity import identity_violations
from attest.plans.jobs import job_policy
from attest.plans.release import build_check, checked_publication, publication_plan, release_check
from attest.plans.screens import evidence_index, screen_check
from attest.plans.status import status_reports
from attest.queries import Tables
from attest.queries.content import upload_sides
from attest.queries.rules import order_rules
from attest.sources.records import parse_records, read_content, read_records, write_json, write_listing

SHA, SHA256 = "a" * 40, "b" * 64


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_first_failure_is_the_lowest_violation(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    rules = order_rules()
    lowest = check(orders, rules, ["o_orderkey"]).groupBy("o_orderkey").agg(F.min_by("rule", "ordinal").alias("rule"))
    first = first_failure(orders, rules).where("first_failure is not null").select("o_orderkey", "first_failure")
    assert rows(lowest) == rows(first)


def test_split_keeps_every_row(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    accepted, quarantined = split_valid(orders, order_rules())
    assert rows(accepted.unionByName(quarantined.drop("broken_rules"))) == rows(orders)
    assert check(accepted, order_rules(), ["o_orderkey"]).isEmpty()


def test_null_outcome_is_a_violation(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert rows(check(df, [Rule("v", F.col("v") > 3, F.col("v"))], ["k"])) == Counter({(1, "v", 1, None): 1})


def test_uploading_the_plan_leaves_only_skips(spark, sf_dir):
    local, remote = upload_sides(Tables(spark, sf_dir))
    planned = plan_uploads(local, remote, ["doc_id"])
    sent = planned.where("action = 'upload'").select(
        "doc_id", F.lit(None).cast("string").alias("declared_sha256"), F.col("sha256").alias("computed_sha256"))
    again = plan_uploads(local, remote.unionByName(sent), ["doc_id"])
    assert again.where("action = 'upload'").isEmpty()
    assert again.where("action = 'skip'").count() == planned.where("action <> 'conflict'").count()


def test_upload_actions(spark):
    local = spark.createDataFrame([("new", "x"), ("declared", "x"), ("computed", "x"), ("stale", "x"), ("other", "x")],
                                  "name string, sha256 string")
    remote = spark.createDataFrame([("declared", "x", None), ("computed", None, "x"), ("stale", "y", "x"), ("other", "y", "y")],
                                   "name string, declared_sha256 string, computed_sha256 string")
    result = {r["name"]: r["action"] for r in plan_uploads(local, remote, ["name"]).collect()}
    assert result == {"new": "upload", "declared": "skip", "computed": "skip", "stale": "skip", "other": "conflict"}


def test_links(spark):
    desired = spark.createDataFrame(
        [("new", "a", "u", "/a"), ("bad", "a", "u", "/a"), ("bad", "b", "u", "/b"), ("mix", "a", "u", "/a"),
         ("mix", "b", "u", "/b"), ("mix", "c", "u", "/c"), ("mix", "d", "u", "/d"), ("blank", "a", "u", "/a")],
        "release string, name string, url string, path string")
    existing = spark.createDataFrame(
        [("bad", "b", "other", "/b", 1, 0), ("mix", "a", "u", "/a", 2, 0), ("mix", "a", "other", "/x", 3, 1),
         ("mix", "b", "u", "/old", 4, 2), ("mix", "c", "u", "/old", None, 3), ("mix", "z", "u", "/z", 9, 4),
         ("blank", "a", None, "/a", 10, 0)],
        "release string, name string, url string, path string, id int, position int")
    result = {(r["release"], r["name"]): r["action"] for r in reconcile_links(desired, existing, "release", "name", "position").collect()}
    assert result == {("new", "a"): "create", ("blank", "a"): "conflict", ("bad", "a"): "conflict", ("bad", "b"): "conflict", ("mix", "a"): "keep",
                      ("mix", "b"): "update_path", ("mix", "c"): "error", ("mix", "d"): "add"}
    groups = spark.createDataFrame([("new",)], "release string")
    again = reconcile_links(desired, existing, "release", "name", "position", existing_groups=groups)
    assert again.where("release = 'new'").first()["action"] == "add", "the group exists, only its links do not"


def test_release_check(spark):
    manifests = spark.createDataFrame(
        [(1, "1.2.3", "v1.2.3", SHA, SHA), (2, "1.2", "v1.2.4", SHA + "\n", "X"), (3, "1.2.3", "v1.2.4", SHA, SHA)],
        "release int, version string, tag string, ref string, client_sha string")
    files = spark.createDataFrame(
        [(1, "p1", "a.deb", SHA256, 10), (1, "p2", "b.apk", SHA256, 10), (2, "p1", "../a", SHA256, 10), (2, "p3", "c.exe", SHA256, 10),
         (2, "p1", "c.exe", "z", 2 << 30), (2, "", "d.exe", SHA256, 10)],
        "release int, path string, name string, sha256 string, size long")
    actual = spark.createDataFrame([("p1", SHA256, 10), ("p2", "c" * 64, 10)], "path string, sha256 string, size long")
    got = {(r["release"], r["item"], r["rule"]) for r in release_check(manifests, files, actual).collect()}
    assert got == {
        (1, "b.apk", "digest_mismatch"), (2, None, "version"), (2, None, "tag_matches_version"), (2, None, "ref"),
        (2, None, "client_sha"), (2, "../a", "name"), (2, "c.exe", "missing"), (2, "c.exe", "duplicate_name"),
        (2, "c.exe", "sha256"), (2, "c.exe", "size_mismatch"), (2, "c.exe", "digest_mismatch"), (2, "d.exe", "path"), (2, "d.exe", "missing"),
        (3, None, "tag_matches_version"), (3, None, "no_files"),
    }


def test_the_real_size_counts_and_a_declared_one_is_optional(spark):
    manifests = spark.createDataFrame([(1, "1.2.3", "v1.2.3", SHA, SHA)], "release int, version string, tag string, ref string, client_sha string")
    files = spark.createDataFrame([(1, "p1", "a.deb", SHA256), (1, "p2", "b.deb", SHA256)], "release int, path string, name string, sha256 string")
    actual = spark.createDataFrame([("p1", SHA256, 1 << 40), ("p2", SHA256, 1 << 30)], "path string, sha256 string, size long")
    got = {(r["item"], r["rule"], r["value"]) for r in release_check(manifests, files, actual).collect()}
    assert got == {("a.deb", "size", str(1 << 40))}


def test_publication_plan_stops_at_bad_targets_and_conflicts(spark):
    releases = spark.createDataFrame([(1, "c1", "v1"), (2, "c9", "v2"), (3, "c1", "v3"), (4, "c1", "v4")], "release int, ref string, tag string")
    commits = spark.createDataFrame([("c1",)], "id string")
    tags = spark.createDataFrame([("v3", "", "c2"), ("v4", None, "c1")], "name string, commit_id string, target string")
    files = spark.createDataFrame([(r, "f", "x") for r in (1, 2, 3, 4)], "release int, name string, sha256 string")
    remote = spark.createDataFrame([(4, "f", None, "y")], "release int, name string, declared_sha256 string, computed_sha256 string")
    links = spark.createDataFrame([], "release int, name string, url string, path string, id int, position int")
    plan = publication_plan(releases, commits, tags, files, remote, links, "https://f.example.com/")
    assert {r["release"]: r["verdict"] for r in plan["targets"].collect()} == {
        1: "new_tag", 2: "missing_commit", 3: "tag_moved", 4: "tag_matches"}
    assert {(r["release"], r["action"]) for r in plan["uploads"].collect()} == {(1, "upload"), (4, "conflict")}
    assert [(r["release"], r["url"], r["action"]) for r in plan["links"].collect()] == [(1, "https://f.example.com/1/f", "create")]


def test_publication_leaves_out_releases_with_violations(spark):
    sha = "a" * 40
    manifests = spark.createDataFrame(
        [(r, f"1.{r}.0", f"v1.{r}.0", sha, sha) for r in (1, 2, 3)] + [(4, "1.4", "v1.4", sha, sha)],
        "release int, version string, tag string, ref string, client_sha string")
    names = ["keep", "moved", "lost", "new"]
    files = spark.createDataFrame([(r, f"{r}/{n}", n, "b" * 64) for r in (1, 2, 3, 4) for n in names],
                                  "release int, path string, name string, sha256 string")
    # A file of release 3 is not there; release 4 has no proper version; release 2 has no links yet.
    actual = files.where("path != '3/new'").selectExpr("path", "sha256", "1L AS size")
    tags = spark.createDataFrame([], "name string, commit_id string, target string")
    remote = spark.createDataFrame([], "release int, name string, declared_sha256 string, computed_sha256 string")
    links = spark.createDataFrame(
        [(r, n, f"https://f/{r}/{n}", path, i, 1) for r in (1, 3, 4)
         for n, path, i in [("keep", "/keep", 1), ("moved", "/old", 2), ("lost", "/old", None)]],
        "release int, name string, url string, path string, id int, position int")
    plan = checked_publication(manifests, files, actual, spark.createDataFrame([(sha,)], "id string"), tags, remote, links, "https://f/")
    assert {(r["release"], r["rule"]) for r in plan["violations"].collect()} == {(3, "missing"), (4, "version"), (4, "tag")}
    assert {r["release"] for r in plan["targets"].collect()} == {1, 2}
    assert {(r["release"], r["name"], r["action"]) for r in plan["links"].collect()} == {
        (1, "keep", "keep"), (1, "moved", "update_path"), (1, "lost", "error"), (1, "new", "add"), *[(2, n, "create") for n in names]}


def test_build_manifest_rules(spark):
    files = spark.createDataFrame(
        [(1, "deb", 5), (1, "apk", 5), (1, "exe", 1 << 30), (2, "deb", 5), (2, "deb", 5), (2, "exe", 5), (3, "deb", 0),
         (3, "apk", 5), (3, "exe", 5), (4, "deb", 5), (5, "deb", 5), (5, "apk", (1 << 30) + 1), (5, "zip", 1)],
        "m int, kind string, size long")
    verdict = {r["m"]: (r["count_ok"], r["kinds_ok"], r["sizes_ok"], r["ok"])
               for r in group_rules(files, ["m"], kind="kind", size="size", expected_kinds=["deb", "apk", "exe"]).collect()}
    assert verdict == {1: (True, True, True, True), 2: (True, False, True, False), 3: (True, True, False, False),
                       4: (False, True, True, False), 5: (True, False, False, False)}


def test_build_manifests(spark):
    builds = spark.createDataFrame([(1, SHA, SHA, "1.2.3-rc_1"), (2, SHA, "b" * 40, "1.2"), (3, None, None, "1.2.3")],
                                   "build int, source_sha string, expected_sha string, version string")
    files = spark.createDataFrame(
        [(1, f"a.{k}", 1 << 30, SHA256) for k in ("deb", "apk", "exe")]
        + [(2, "a.deb", 0, SHA256), (2, "b/c.deb", 5, "z"), (2, "a.zip", (1 << 30) + 1, SHA256)], "build int, name string, size long, sha256 string")
    got = {(r["build"], r["item"], r["rule"]) for r in build_check(builds, files).collect()}
    assert got == {(2, None, "source"), (2, None, "version"), (2, "a.deb", "size"), (2, "b/c.deb", "name"), (2, "b/c.deb", "sha256"),
                   (2, "a.zip", "kind"), (2, "a.zip", "size"), (2, None, "files"), (3, None, "source"), (3, None, "files")}


def test_runs(spark):
    runs = spark.createDataFrame([("w", 1), ("w", 3), ("w", 3), ("v", 2), ("w", (1 << 53) + 5)], "w string, id long")
    assert rows(mark_superseded(runs, ["w"], "id")) == Counter(
        {("w", 1, True): 1, ("w", 3, False): 2, ("v", 2, False): 1, ("w", (1 << 53) + 5, False): 1})
    history = spark.createDataFrame(
        [("a", 1, "completed", "success"), ("a", 2, "in_progress", None), ("b", 5, "completed", "failure"), ("b", 9, "completed", "success")],
        "sha string, n int, status string, conclusion string")
    keys = spark.createDataFrame([("a",), ("b",), ("none",)], "sha string")
    gates = gate_for(keys, latest_gate(history, ["sha"], "n", "status", "conclusion"), ["sha"])
    assert {r["sha"]: r["passed"] for r in gates.collect()} == {"a": False, "b": True, "none": False}


def test_run_eligibility(spark):
    base = {"id": 7, "event": "push", "head_branch": "release", "head_sha": SHA, "html_url": "u/7", "repository": "r", "head_repository": "r"}
    cases = [({}, None, None), ({"event": "schedule"}, None, "UNSUPPORTED_EVENT"), ({"event": None}, None, "UNSUPPORTED_EVENT"),
             ({"head_branch": "main"}, None, "UNSUPPORTED_BRANCH"), ({"head_repository": "fork"}, "repository", None),
             ({"repository": None, "event": "x"}, "repository", None), ({"head_sha": SHA.upper()}, "head_sha", None),
             ({"html_url": "u/8"}, "html_url", None), ({"event": "schedule", "head_sha": "x"}, None, "UNSUPPORTED_EVENT")]
    schema = "id int, event string, head_branch string, head_sha string, html_url string, repository string, head_repository string"
    for change, problem, reason in cases:
        df = spark.createDataFrame([tuple({**base, **change}.values())], schema)
        row = classify_runs(df, "r", "push", "release", "u/").first()
        assert (row["problem"], row["reason"]) == (problem, reason), change


def test_failed_first_attempt_leaves_no_release(spark):
    attempts = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False), (4, "d", True)], "n int, sha string, ok boolean")
    result = effective_release(attempts.withColumn("host", F.lit("h")), ["host"], ["n"], "sha", F.col("ok"))
    assert [r["effective"] for r in result.orderBy("n").collect()] == [None, "b", "b", "d"]


def test_report_gate(spark):
    outcomes = {"good": ["expected"] * 3, "empty": ["other"], "flaky": ["expected", "flaky"], "error": ["expected", "error"], "skip": ["expected", "skipped"]}
    df = spark.createDataFrame([(k, o) for k, os in outcomes.items() for o in os], "k string, o string")
    assert {r["k"]: r["passed"] for r in report_gate(df, ["k"], "o").collect()} == {
        "good": True, "empty": False, "flaky": False, "error": False, "skip": False}


def test_options_compare_as_text_and_last_wins(spark):
    options = spark.createDataFrame([("a", "true", 0), ("a", "false", 1), ("b", None, 2), ("c", "False", 3)], "key string, value string, pos int")
    target = spark.createDataFrame([("a", "false"), ("b", ""), ("c", "false"), ("d", "x")], "key string, value string")
    drift = option_drift(current_options(options, "key", "value", "pos"), target, "key")
    assert rows(drift.select("key", "current_value", "target_value")) == Counter({("c", "False", "false"): 1, ("d", None, "x"): 1})


def test_screens(spark):
    long = "d" * 200
    step = T.StructType([T.StructField(n, T.StringType()) for n in ("to", "action", "confidence")])
    schema = T.StructType([
        T.StructField("index", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("id", "description", "title", "summary", "category")],
        T.StructField("controls", T.ArrayType(T.StringType())), T.StructField("transitions", T.ArrayType(step))])
    df = spark.createDataFrame([
        (0, "S-000", long, "t", "s", "c", [], [("S-001", "tap", "inferred"), ("S-009", "tap", "inferred")]),
        (1, "S-1", long[1:], "", None, "c", None, None),
        (2, "S-002", long, "t", "s", "c", ["x"], [("S-000", "", "inferred"), ("S-000", "tap", "seen")]),
        (1234, "S-1234", long, "t", "s", "c", ["x"], []),
    ], schema)
    got = {(r["id"], r["rule"]) for r in screen_check(df, 3, prefix="S-").collect()}
    assert got == {("S-1", "id"), ("S-1", "description"), ("S-1", "title"), ("S-1", "summary"), ("S-1", "controls"),
                   ("S-002", "confidence"), ("S-002", "action"), ("S-1234", "index")}
    journeys = spark.createDataFrame([(0, "first", ["S-000", "S-777"]), (1, "second", ["S-000", "S-002"])], "position int, title string, nodes array<string>")
    index = evidence_index(df, journeys)
    assert [(r["to"], r["n_edges"]) for r in index["unknown_targets"].collect()] == [("S-001", 1), ("S-009", 1)] or \
        rows(index["unknown_targets"]) == Counter({("S-001", 1): 1, ("S-009", 1): 1})
    assert [r["to"] for r in index["unknown_members"].collect()] == ["S-777"]
    assert {r["id"] for r in index["uncovered"].collect()} == {"S-1", "S-1234"}
    assert [(r["id"], r["category"], r["state_category"]) for r in index["screens"].collect()] == [
        ("S-000", "first", "c"), ("S-1", None, "c"), ("S-002", "second", "c"), ("S-1234", None, "c")]


def test_job_policy(spark):
    schema = "name string, runs_on string, timeout_minutes int, steps array<struct<uses string, run string, with map<string,string>>>"
    pinned = "actions/checkout@" + SHA
    upload = "actions/upload-artifact@" + SHA
    jobs = spark.createDataFrame([
        ("good", "ubuntu", 60, [(pinned, None, None), (None, "pull", None), (upload, None, {"if-no-files-found": "error", "path": "out"}), (None, "test", None)]),
        ("bad", "self-hosted", 61, [(None, "test", None), ("actions/checkout@v4", None, None), (upload, None, {"path": "test-results/x"}), (None, "pull", None)]),
        ("none", "ubuntu", None, [(pinned, None, None)]),
    ], schema)
    got = {(r["job"], r["position"], r["rule"]) for r in job_policy(jobs, F.col("run") == "pull", F.col("run") == "test").collect()}
    assert got == {("bad", None, "hosted_runner"), ("bad", None, "timeout"), ("bad", 1, "pinned"), ("bad", 2, "artefact_required"),
                   ("bad", 2, "artefact_path"), ("bad", None, "step_order"), ("none", None, "timeout"), ("none", None, "step_order")}


def test_identity_shape(spark):
    texts = ['{"email": "a@b.cd"}', '{"email": "a@b.cd", "x": 1}', "{}", '{"email": "nope"}', '{"email": "%s@b.cd"}' % ("a" * 254), "nope",
             '{"email": null}', '{"email": ["a@b.co"]}', '{"email": 7}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["i"], r["rule"]) for r in identity_violations(df, "t", ["i"]).collect()}
    assert got == {(1, "additional"), (2, "required:email"), (3, "format:email"), (4, "length:email"), (5, "object"),
                   (6, "type:email"), (7, "type:email"), (8, "type:email"), (8, "format:email")}


def test_deploy_provenance(spark):
    good = ("r", SHA, "c" * 40, "linux-amd64", SHA256, SHA, "c" * 40, SHA256)
    names = ["repository", "commit", "backend", "platform", "sha256", "expected_commit", "expected_backend", "content_sha256"]
    changed = [good] + [good[:i] + ("z",) + good[i + 1:] for i in range(5)] + [good[:5] + ("Z",) + good[6:]]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(changed)], ["i", *names])
    result = [r["problem"] for r in deploy_check(df, "r").orderBy("i").collect()]
    assert result == [None, "repository", "commit", "backend", "platform", "sha256", "expected_commit"]


def test_capture_matrix(spark):
    states = spark.createDataFrame([("s", "real", 10)], "state string, evidence string, started long")
    captures = spark.createDataFrame(
        [("s", "phone", "light", "real", 10), ("s", "phone", "dark", "real", 9), ("s", "desktop", "light", "fake", 12),
         ("s", "tablet", "light", "real", 12), ("s", "tablet", "light", "real", 13)],
        "state string, viewport string, theme string, evidence string, taken long")
    dims = {"viewport": ["phone", "tablet", "desktop"], "theme": ["light", "dark"]}
    result = expect_matrix(states, captures, "state", dims, "evidence", "taken", "started")
    assert {(r["viewport"], r["theme"]): r["verdict"] for r in result.collect()} == {
        ("phone", "light"): "ok", ("phone", "dark"): "stale", ("desktop", "light"): "metadata",
        ("tablet", "light"): "ambiguous", ("tablet", "dark"): "missing", ("desktop", "dark"): "missing"}


def test_suffix_match(spark):
    items = spark.createDataFrame([(1,), (11,), (2,)], "i long")
    files = spark.createDataFrame([("shot 1.png",), ("shot 11.png",), ("shot2.png",), ("shot 02.png",), ("shot 2.jpg",)], "f string")
    result = {r["i"]: r["matched_file"] for r in match_by_suffix(items, files, "i", "f").collect()}
    assert result == {1: "shot 1.png", 11: "shot 11.png", 2: None}


def test_records(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    texts = {"one": '{"id": 1, "name": "a"}', "batch": '[{"id": 2}, {"id": 3, "name": "c"}]', "bad": '{"id": ', "scalar": "7",
             "type": '{"id": "x"}', "mixed": '[{"id": 4}, 5]', "empty": "[]", "large": '{"id": 6, "name": "%s"}' % ("x" * 100)}
    for name, text in texts.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(text)
    accepted, refused = read_records(spark, str(tmp_path / "in"), schema, max_bytes=64)
    assert rows(accepted.select("id", "name")) == Counter({(1, "a"): 1, (2, None): 1, (3, "c"): 1})
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in refused.collect()}
    assert problems == {"bad.json": "bad_json", "scalar.json": "bad_json", "type.json": "bad_json", "mixed.json": "bad_json", "large.json": "too_large"}
    content = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in read_content(spark, str(tmp_path / "in"), max_bytes=64).collect()}
    import hashlib

    assert content["one.json"] == (22, hashlib.sha256(texts["one"].encode()).hexdigest())
    assert content["large.json"][1] is None
    write_json(accepted.select("id", "name"), str(tmp_path / "out"))
    assert rows(spark.read.schema(schema).json(str(tmp_path / "out"))) == rows(accepted.select("id", "name"))
    write_listing(spark.createDataFrame([(1, "z  c\n"), (0, "x  a\ny  b\n")], "block int, text string"), str(tmp_path / "sums"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sums")).collect()] == ["x  a", "y  b", "z  c"]


def test_records_from_a_column(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, None)], "i int, body string")
    accepted, refused = parse_records(df, "body", T.StructType([T.StructField("k", T.LongType())]))
    assert rows(accepted.select("i", "k")) == Counter({(1, 1): 1})
    assert rows(refused.select("i", "problem")) == Counter({(2, "bad_json"): 1})


def test_readiness_and_folded_captures(spark):
    checks = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("a", "x", True), ("b", "x", True), ("c", "z", False), ("c", "x", None)],
                                   "g string, c string, ok boolean")
    result = {r["g"]: (r["n_checks"], r["failures"], r["ready"]) for r in readiness(checks, ["g"], "c", "ok", ["y", "x"]).collect()}
    assert result == {"a": (2, ["y"], False), "b": (1, [], True), "c": (2, ["x", "other"], False)}
    captures = spark.createDataFrame([("s", "phone", "light", "1"), ("s", "phone", "light", "2"), ("s", "desktop", "dark", "3"), ("s", "watch", "dark", "4")],
                                     "state string, viewport string, theme string, file string")
    dims = {"viewport": ["phone", "desktop"], "theme": ["light", "dark"]}
    row = fold_captures(captures, ["state"], dims, "file").first()
    assert row["captures"] == {"phone-light": "2", "desktop-dark": "3"} and row["n_captures"] == 3


def test_documents_are_one_object_or_one_batch(spark):
    good = {'{"k":1}': [1], '\n [{"k":1},{"k":2}]\t': [1, 2], "[]": [], '{"k":1,"x":{"y":[1]}}': [1]}
    bad = ["", " \n", None, '{"k":1},{"k":2}', '{"k":1}{"k":2}', '{"k":1} x', '{"k":1}],[{"k":2}', '{"k":1}}', "[1]", "7", "nul", '[{"k":1}] ]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "i int, body string")
    accepted, refused = parse_records(df, "body", T.StructType([T.StructField("k", T.LongType())]))
    got = {}
    for r in accepted.collect():
        got.setdefault(r["body"], []).append(r["k"])
    assert got == {t: k for t, k in good.items() if k}
    assert sorted(r["i"] for r in refused.collect()) == list(range(len(good), len(good) + len(bad)))


def test_assets_resolve_like_a_browser(spark):
    page = "https://a.example/en/25?page=2#top"
    cases = {
        "y.js": ("https://a.example/en/y.js", True), "../z.css": ("https://a.example/z.css", True), "./a/../b/.": ("https://a.example/en/b/", True),
        "../../..": ("https://a.example/", True), "/r/../s.js?q=../x": ("https://a.example/s.js?q=../x", True), "?v=1": ("https://a.example/en/25?v=1", True),
        "#end": ("https://a.example/en/25?page=2#end", True), "https://a.example:443/x.js": ("https://a.example:443/x.js", True),
        "https://u:p@A.example/x.js": ("https://u:p@A.example/x.js", True), "https://a.example:8443/x.js": ("https://a.example:8443/x.js", False),
        "http://a.example/x.js": ("http://a.example/x.js", False), "//b.example/x": ("https://b.example/x", False),
        "//a.example/x": ("https://a.example/x", True), "mailto:a@a.example": ("mailto:a@a.example", False), "data:,x": ("data:,x", False),
    }
    html = "".join(f'<a href="{c}">' for c in cases)
    rows = spark.createDataFrame([(page, html)], "url string, html string")
    got = {r["asset"]: (r["resolved"], r["same_origin"]) for r in extract_assets(rows, "html", "url", r"[^\"]+").collect()}
    assert got == cases


def test_releases_extend_the_pinned_version_in_its_grammar(spark):
    versions = {"1.0.0": "ok", "1.0.0-rc.1": "ok", "1.0.0-": "release_version", "1.0.0-a/b c": "release_version", "1.0.0.1": "release_version"}
    builds = spark.createDataFrame([("c", "s", "1.0.0", v) for v in versions], "c string, source_sha string, version string, release_version string")
    pins = spark.createDataFrame([("c", "s", "1.0.0")], "c string, pinned_sha string, pinned_version string")
    assert {r["release_version"]: r["verdict"] for r in match_pins(builds, pins, ["c"]).collect()} == versions


def test_untrusted_newer_run_supersedes(spark):
    rows = [(5, "ci", "https://h/5"), (9, "ci", "https://elsewhere/9"), (3, "other", "https://h/3")]
    runs = spark.createDataFrame(rows, "id long, name string, html_url string").selectExpr(
        "*", "1 AS workflow_id", f"'{SHA}' AS head_sha", "'push' AS event", "'release' AS head_branch", "'r' AS repository", "'r' AS head_repository",
        "'completed' AS status", "'success' AS conclusion").withColumn("workflow_id", F.col("name"))
    got = {(r["id"], r["problem"], r["state"]) for r in status_reports(runs, "r", {"ci": "c"}, "https://h/", "s").collect()}
    assert got == {(9, "html_url", None), (3, "unknown_name", None)}

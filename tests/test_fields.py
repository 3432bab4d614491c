"""Accepted and rejected values of every field and text rule."""

import pytest
from pyspark.sql import functions as F

from attest.functions.network import in_cidr
from attest.functions.predicates import PathPolicy, check_origin, classify_path, field_rule, is_hex, is_safe_name, is_version
from attest.functions.state import map_run_state
from attest.functions.text import (
    describe_run,
    document_rewrites,
    extract_code,
    first_line,
    parse_change_title,
    redact,
    rewrite_path,
)

SHA = "0123456789abcdef0123456789abcdef01234567"


def evaluate(spark, values, column, schema="v string"):
    rows = [(i, v) if not isinstance(v, tuple) else (i, *v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_hex(spark):
    values = [SHA, SHA.upper(), SHA + "\n", SHA[:-1], SHA + "0", "g" + SHA[1:], "", None]
    assert evaluate(spark, values, is_hex("v", 40)) == [True] + [False] * 7
    assert evaluate(spark, values, is_hex("v", 40, ignore_case=True)) == [True, True] + [False] * 6


@pytest.mark.parametrize("mode, good, bad", [
    ("strict", ["0.1.0", "10.20.30", "1.2.3-rc.0", "1.2.3-alpha.11"],
     ["01.2.3", "1.2", "1.2.3-rc.01", "1.2.3-dev.1", "1.2.3-rc", "v1.2.3", "1.2.3\n", None]),
    ("release", ["1.2.3", "01.2.3", "1.2.3-rc-1.x"], ["1.2.3-", "1.2.3+b", "v1.2.3", "1.2.3-a_b", "1.2.3\n"]),
    ("build", ["1.2.3", "1.2.3-a_b.1"], ["1.2", "v1.2.3", "1.2.3-é", "1.2.3\n"]),
    ("tag", ["v1.2.3", "v1.2.3-beta.1"], ["1.2.3", "V1.2.3", "v1.2", "v1.2.3\n"]),
    ("mirror", ["refs/heads/release", "refs/tags/v1.2.3", "refs/tags/v1.2.3-rc.1"],
     ["refs/heads/main", "refs/tags/1.2.3", "refs/heads/release/x", "release"]),
])
def test_versions(spark, mode, good, bad):
    assert evaluate(spark, good + bad, is_version("v", mode)) == [True] * len(good) + [False] * len(bad)


def test_file_names(spark):
    good, bad = ["app_1.2-3.deb", ".hidden", "..."], ["", ".", "..", "../x", "a/b", "a b", "a\\b", "naïve", "x\n", None]
    assert evaluate(spark, good + bad, is_safe_name("v")) == [True] * 3 + [False] * len(bad)


def test_origins(spark):
    cases = {
        "https://git.example.com": None, "https://git.example.com/": None, "https://GIT.Example.com:443": None,
        "": None, "   ": None, "http://git.example.com": "protocol", "https://git.example.com:8443": "host",
        "https://evil.example.com": "host", "https://git.example.com.evil.com": "host",
        "https://user:pw@git.example.com": "credentials", "https://user@git.example.com/": "credentials",
        "https://git.example.com?x=1": "query", "https://git.example.com/?": None,
        "https://git.example.com/api": "path", "https://git.example.com/#a": "fragment", "not a url": "invalid_url",
        "git.example.com": "invalid_url",
    }
    assert evaluate(spark, list(cases), check_origin("v", ["git.example.com"])) == list(cases.values())


@pytest.mark.parametrize("kind, good, bad", [
    ("port", ["1", "443", "65535"], ["0", "65536", "-1", "x", "", "1.5", None]),
    ("unprivileged_port", ["1025", "8443", "65535"], ["1024", "443", "65536"]),
    ("loopback", ["127.0.0.1:80", "127.0.0.1:65535"], ["0.0.0.0:80", "127.0.0.1", "127.0.0.1:123456", "localhost:80"]),
    ("absolute_path", ["/srv/app_1.x-y"], ["srv/app", "/srv/a b", "/", ""]),
    ("host", ["h", "a.example-1.com"], ["-a.com", ".a", "a_b", ""]),
    ("service_name", ["api-server", "a1"], ["A", "1a", "a_b", "a"]),
    ("image_pin", ["db/x:1.2-3"], ["db/x", "db/x:", "db/x:a b", "other:1", "dbxx:1"]),
    ("email", ["a@b.cd"], ["a@b", "a b@c.de", "@b.cd", "a@b@c.de", "a@b.cd\n"]),
    ("smtp_uri", ["smtp://h:25", "smtps://u:p@h:465/?x=1"],
     ["http://h", "smtps://", "smtps://h/?skip_ssl_verify=true", "smtp://h/?disable_starttls=true"]),
    ("short_name", ["a", "a" * 12], ["", "a" * 13, None]),
    ("cidr", ["10.0.0.0/8", "2001:db8::/32"], ["0.0.0.0/0", "::/0", "any", "10.0.0.0/8 "]),
])
def test_configuration_fields(spark, kind, good, bad):
    result = evaluate(spark, good + bad, field_rule(kind, "v", repository="db/x"))
    assert result == [True] * len(good) + [False] * len(bad)


def test_private_paths(spark):
    cases = {
        "README.md": None, "src/.env.example": None, "src/keys.ts": None, "docs/06-ui.mdx": None, "a/terraform/x": None,
        "NOTES.md": "exact", "docs/NOTES.md": None, "private/x": "prefix", "ops/local/x.yml": "prefix",
        "docs/content/docs/03-x.mdx": "path_pattern", "docs/content/docs/08-x.mdx": None,
        "scripts/web-probe.mjs": "path_pattern", "img/MOCKUPS set.ZIP": "name_pattern",
        "a/b.private.json": "private_marker", ".env": "environment", "a/.env.local": "environment",
        "a/.environment": None, "tls/site.pem": "key_or_state", "x.tfstate.backup": "key_or_state", "x.keys": None,
        "data/app.sqlite3": "database", "dump.sql.gz": "database", "x.db.md": None, "app.jks": "keystore",
        "android/local.properties": "name", "kubeconfig": "name", "a/.terraform/b": "segment",
    }
    policy = PathPolicy(
        exact=("NOTES.md",), prefixes=("private/", "ops/local/"), name_patterns=(r"(?i)\Amockups.*\.zip\z",),
        path_patterns=(r"\Adocs/content/docs/0[1-7]-.*\.mdx\z", r"\Ascripts/.*probe"))
    assert evaluate(spark, list(cases), classify_path("v", policy)) == list(cases.values())
    assert evaluate(spark, ["NOTES.md", "private/x", "a/.env"], classify_path("v")) == [None, None, "environment"]


def test_change_titles(spark):
    cases = {
        "✨ [v1.2.3] feat(web/ui): add search": None,
        "♻️ [v1.2.3] refactor!: split": None,
        "✨ [v1.2.3] feat: add\n\nlong body": None,
        "feat: add": "shape", "✨ [v1.2.3] feat : add": "shape", "✨ [v1.2.3] feat(Web): add": "shape",
        "🐛 [v1.2.3] feat: add": "emoji", "✨ [v1.2.3] feature: add": "emoji",
        "✨ [v1.2.4] feat: add": "version",
        "✨ [v1.2.3] feat: " + "é" * 83: None, "✨ [v1.2.3] feat: " + "é" * 84: "length",
        "✨ [v1.2.3] feat: add ": "outer_space", "✨ [v1.2.3] feat: add\u3000": "outer_space",
        "✨ [v1.2.3] feat: \u00a0add": "shape",
    }
    result = evaluate(spark, list(cases), parse_change_title("v", F.lit("1.2.3"))["problem"])
    assert result == list(cases.values())
    assert evaluate(spark, ["✨ [v01.2.3] feat: add"], parse_change_title("v", F.lit("01.2.3"))["problem"]) == ["expected_version"]
    parsed = evaluate(spark, ["✨ [v1.2.3-rc.1] feat(web/ui)!: add search"], parse_change_title("v", F.lit("1.2.3-rc.1")))[0]
    assert (parsed.version, parsed.type, parsed.scope, parsed.breaking, parsed.summary) == (
        "1.2.3-rc.1", "feat", "web/ui", True, "add search")


def test_redaction(spark):
    texts = ["key s3cret! and abc", "Bearer \u00a0abc.DEF-1 end", "x glpat-AbC_1 y ghp_22 z github_pat_3", "plain", None]
    assert evaluate(spark, texts, redact("v", ["s3cret!", "abc"])) == [
        "key [REDACTED] and abc", "[REDACTED] end", "x [REDACTED] y [REDACTED] z [REDACTED]", "plain", None]


def test_run_states(spark):
    cases = {
        ("queued", None): "pending", ("in_progress", None): "running", ("waiting", "success"): "pending",
        ("completed", "success"): "success", ("completed", "failure"): "failed", ("completed", "timed_out"): "failed",
        ("completed", "action_required"): "failed", ("completed", "cancelled"): "canceled",
        ("completed", "skipped"): "skipped", ("completed", "neutral"): "skipped", ("completed", "stale"): "failed",
        ("completed", None): "failed", (None, None): "pending",
    }
    assert evaluate(spark, list(cases), map_run_state("s", "c"), "s string, c string") == list(cases.values())


def test_descriptions_codes_and_lines(spark):
    text = describe_run(F.lit("CI"), "s", F.lit("completed"), "c")
    result = evaluate(spark, [("w", "success"), ("w", None), ("w" * 300, "x")], text, "s string, c string")
    assert result[:2] == ["CI [w]: completed (success)", "CI [w]: completed"] and len(result[2]) == 255
    assert evaluate(spark, ["code 123456.", "1234567 12345", "a1234567 654321", "é123456é", None], extract_code("v")) == [
        "123456", None, "654321", "123456", None]
    assert evaluate(spark, ["a\r\nb", "a\nb", "a", "", "\nb"], first_line("v")) == ["a", "a", "a", "", ""]


def test_path_rewrites(spark):
    paths = ["/docs/a/b.md", "/docs.md", "/docs/a/b", "/docs", "/blog/a.md", "/docsx"]
    suffix_only = rewrite_path("v", document_rewrites("/docs", "/raw"))
    assert evaluate(spark, paths, suffix_only) == ["/raw/a/b/content.md", "/raw/content.md", "/docs/a/b", "/docs", "/blog/a.md", "/docsx"]
    both = rewrite_path("v", document_rewrites("/docs", "/raw", negotiated=True))
    assert evaluate(spark, paths, both) == [
        "/raw/a/b/content.md", "/raw/content.md", "/raw/a/b/content.md", "/raw/content.md", "/blog/a.md", "/docsx"]


def test_address_ranges(spark):
    addresses = ["10.0.0.1", "11.0.0.1", "192.168.4.7", "10.0.0.256", "010.0.0.1", "2001:db8::5", "2001:db9::5", "::ffff:10.0.0.1", "x", None]
    result = evaluate(spark, addresses, in_cidr("v", ["10.0.0.0/8", "192.168.4.0/30", "192.168.4.4/30", "2001:db8::/32"]))
    assert result == [True, False, True, False, False, True, False, False, False, False]
    for refused in (["0.0.0.0/0"], ["::/0"], ["1.2.3.4/0"], ["10.0.0.0/00"], ["2001:db8::/0"], ["anything"], []):
        with pytest.raises(ValueError):
            in_cidr("v", refused)

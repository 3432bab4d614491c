"""Release manifests: validation, and the plan of a publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.content import packed, packed_hex, unpacked
from attest.functions.predicates import MAX_FILE_BYTES, is_hex, is_safe_name, is_version
from attest.operators.digests import plan_uploads, verify_digests
from attest.operators.reconcile import reconcile_links, verify_targets
from attest.operators.rules import Rule, any_broken, check
from attest.operators.sets import group_rules, outcome_summary
from attest.operators.skew import SLICE_ROWS, lookup_join
from attest.session import written, written_by_share

# Fixed value: a build has one file of each kind.
BUILD_KINDS = ("deb", "apk", "exe")
# Joins of all files are done for one share of the keys after the other, so that the disk holds the shuffles of one share.
# More shares read the tables more often.
PATH_SHARES, RELEASE_SHARES = 2, 3


def release_check(
    manifests: DataFrame,
    files: DataFrame,
    actual: DataFrame,
    max_size: int = MAX_FILE_BYTES,
    slice_rows: int | None = SLICE_ROWS,
    shares: int = 1,
) -> DataFrame:
    """Everything wrong with a set of releases: ``release``, ``item``, ``rule``, ``value``.

    ``manifests(release, version, tag, ref, client_sha)``, ``files(release, path, name, sha256)``, where ``size`` may be
    declared too, ``actual(path, sha256, size)``. The size limit judges what is there, not what is declared. An empty
    result means the releases may be published. With more than one of ``shares``, files are compared with what is there
    one share of the paths after the other, and what is wrong with them is kept in the shared folder.
    """
    if "size" not in files.columns:
        files = files.withColumn("size", F.lit(None).cast("bigint"))
    head = check(manifests, _manifest_rules(), ["release"]).select(
        "release", F.lit(None).cast("string").alias("item"), "rule", "value"
    )
    # One aggregate says both which names repeat and which releases have no file.
    named = files.select("release", F.col("name").cast("string").alias("item"), F.lit(1).alias("n"))
    none = manifests.select("release", F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"))
    names = named.unionByName(none).groupBy("release", "item").agg(F.sum("n").alias("n"))
    repeated = names.where(F.col("n") > 1).select(
        "release", "item", F.lit("duplicate_name").alias("rule"), F.col("n").cast("string").alias("value")
    )
    per_release = names.groupBy("release").agg(F.sum("n").alias("n"))
    empty = per_release.where(F.col("n") == 0).select(
        "release", F.lit(None).cast("string").alias("item"), F.lit("no_files").alias("rule"),
        F.lit(None).cast("string").alias("value"),
    )

    def wrong_files(files: DataFrame, actual: DataFrame) -> DataFrame:
        # Digests meet packed, being most of what is shuffled; the rules unpack those that they show.
        compared = verify_digests(
            files.withColumn("sha256", packed("sha256")), actual.withColumn("sha256", packed("sha256")), ["path"], slice_rows)
        # On packed digests the rules cost less than a row for each of them.
        rules = [*_file_rules(max_size), *_content_rules()]
        return check(compared.where(any_broken(rules)), rules, ["release", "name"]).select(
            "release", F.col("name").alias("item"), "rule", "value"
        )

    per_file = wrong_files(files, actual) if shares <= 1 else written_by_share(
        wrong_files, [files, actual], ["path"], shares, "wrong_files", "zstd")
    return head.unionByName(empty).unionByName(repeated).unionByName(per_file)


def _manifest_rules() -> list[Rule]:
    return [
        Rule("version", is_version("version", "release"), F.col("version")),
        Rule("tag", is_version("tag", "tag"), F.col("tag")),
        Rule("tag_matches_version", F.col("tag") == F.concat(F.lit("v"), "version"), F.col("tag")),
        Rule("ref", is_hex("ref", 40), F.col("ref")),
        Rule("client_sha", is_hex("client_sha", 40), F.col("client_sha")),
    ]


def _file_rules(max_size: int) -> list[Rule]:
    """Rules of files whose digests are packed."""
    return [
        Rule("name", is_safe_name("name"), F.col("name")),
        Rule("sha256", packed_hex("sha256", 64), unpacked("sha256")),
        Rule("path", F.coalesce(F.col("path"), F.lit("")) != "", F.col("path")),
        Rule("size", F.col("actual_size").isNull() | (F.col("actual_size") <= max_size), F.col("actual_size")),
    ]


def _content_rules() -> list[Rule]:
    seen, there = unpacked("actual_sha256"), F.col("verdict") != "missing"
    size = F.col("size").isNull() | F.col("size").eqNullSafe(F.col("actual_size"))
    return [
        Rule("missing", there, seen),
        Rule("size_mismatch", ~there | size, seen),
        Rule("digest_mismatch", ~there | F.col("sha256").eqNullSafe(F.col("actual_sha256")), seen),
    ]


def build_check(builds: DataFrame, files: DataFrame, max_size: int = MAX_FILE_BYTES) -> DataFrame:
    """Everything wrong with a set of builds: ``build``, ``item``, ``rule``, ``value``.

    ``builds(build, source_sha, expected_sha, version)``, ``files(build, name, size, sha256)``: the source is the pinned
    one, the version has its grammar, and there is exactly one file of each kind, with a bare name, a whole size in
    (0, ``max_size``] and a digest.
    """
    kind = F.regexp_extract("name", r"\.([a-z0-9]+)\z", 1)
    size = F.col("size")
    head = check(builds, [
        Rule("source", is_hex("source_sha", 40) & F.col("source_sha").eqNullSafe(F.col("expected_sha")), F.col("source_sha")),
        Rule("version", is_version("version", "build"), F.col("version")),
    ], ["build"]).select("build", F.lit(None).cast("string").alias("item"), "rule", "value")
    each = check(files, [
        Rule("name", is_safe_name("name"), F.col("name")),
        Rule("kind", kind.isin(*BUILD_KINDS), kind),
        Rule("size", (size > 0) & (size <= max_size) & (size == F.floor(size)), size),
        Rule("sha256", is_hex("sha256", 64), F.col("sha256")),
    ], ["build", "name"]).select("build", F.col("name").alias("item"), "rule", "value")
    groups = group_rules(files.withColumn("__kind", kind), ["build"], kind="__kind", size="size", expected_kinds=BUILD_KINDS)
    whole = builds.select("build").join(groups, "build", "left").where(
        ~F.coalesce(F.col("count_ok") & F.col("kinds_ok"), F.lit(False)))
    sets = whole.select("build", F.lit(None).cast("string").alias("item"), F.lit("files").alias("rule"),
                        F.coalesce("n_rows", F.lit(0)).cast("string").alias("value"))
    return head.unionByName(each).unionByName(sets)


def publication_plan(
    releases: DataFrame,
    commits: DataFrame,
    tags: DataFrame,
    files: DataFrame,
    remote: DataFrame,
    links: DataFrame,
    address_prefix: str,
    slice_rows: int = SLICE_ROWS,
    shares: int = 1,
) -> dict[str, DataFrame]:
    """Plan a publication without applying it: target verdicts, uploads, links and a summary per release.

    Only releases whose target is acceptable go on, and a release with a conflicting upload gets no links.
    ``releases(release, ref, tag)``, ``files(release, name, sha256)``, ``remote(release, name,
    declared_sha256, computed_sha256)``, ``links(release, name, url, path, id, position)``. Targets and
    uploads are read several times, so each is computed once and kept in the shared folder; uploads are planned for one of
    ``shares`` of the releases after the other.
    """
    targets = written(verify_targets(releases, commits, tags, slice_rows), "targets", "zstd", remove_shuffles=True)
    sound = targets.where(F.col("verdict").isin("new_tag", "tag_matches")).select("release")
    digests = ["sha256", "declared_sha256", "computed_sha256"]

    def planned(files: DataFrame, remote: DataFrame, sound: DataFrame) -> DataFrame:
        # Digests meet packed, being most of what is shuffled, and are kept so; one that the file has is kept empty.
        local, there = (t.withColumns({c: packed(c) for c in digests if c in t.columns}) for t in (files, remote))
        wanted = local.join(sound, "release", "left_semi")
        plan = plan_uploads(wanted, there, ["release", "name"], slice_rows=None)
        same = {c: F.when(F.col(c) == F.col("sha256"), F.lit("")).otherwise(F.col(c)) for c in digests[1:]}
        return plan.withColumns({c: x.cast("binary") for c, x in {"sha256": F.col("sha256"), **same}.items()})

    kept = written_by_share(planned, [files, remote, sound], ["release"], shares, "uploads", "zstd")
    uploads = kept.withColumns({c: unpacked(F.when(F.length(c) == 0, F.col("sha256")).otherwise(F.col(c))) for c in digests})
    summary = outcome_summary(uploads, ["release"], "action", ["upload", "skip", "conflict"])
    clean = summary.where(F.col("n_conflict") == 0).select("release")
    publishable = lookup_join(uploads, clean, ["release"], "left_semi", slice_rows, distinct_by=["name"])
    desired = publishable.select(
        "release",
        "name",
        F.concat(F.lit(address_prefix), F.concat_ws("/", "release", "name")).alias("url"),
        F.concat(F.lit("/"), F.col("name").cast("string")).alias("path"),
    )
    return {
        "targets": targets,
        "uploads": uploads,
        "links": reconcile_links(desired, links, "release", "name", "position", slice_rows, sized_by=uploads),
        "summary": summary,
    }


def checked_publication(
    manifests: DataFrame,
    files: DataFrame,
    actual: DataFrame,
    commits: DataFrame,
    tags: DataFrame,
    remote: DataFrame,
    links: DataFrame,
    address_prefix: str,
    max_size: int = MAX_FILE_BYTES,
    slice_rows: int = SLICE_ROWS,
    path_shares: int = PATH_SHARES,
    release_shares: int = RELEASE_SHARES,
) -> dict[str, DataFrame]:
    """``publication_plan`` of the releases in which ``release_check`` finds nothing wrong, and its ``violations``.

    The tables are those of ``release_check`` and ``publication_plan``. A release with any violation is left out whole:
    it has no target verdict, upload, link or summary. Files are checked one of ``path_shares`` after the other, uploads
    planned one of ``release_shares`` after the other.
    """
    found = release_check(manifests, files, actual, max_size, slice_rows, path_shares)
    violations = written(found, "violations", "zstd", remove_shuffles=True)
    # One row per refused release.
    valid = manifests.join(violations.select("release").distinct(), "release", "left_anti").select("release", "ref", "tag")
    plan = publication_plan(
        valid, commits, tags, files.select("release", "name", "sha256"), remote, links, address_prefix, slice_rows,
        release_shares)
    return {"violations": violations, **plan}

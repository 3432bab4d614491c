"""Field predicates: hex digests, versions, names, origins, configuration fields, paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.columns import SPACE, ColumnLike, as_column, first_of, matches

# The grammars every consumer of a release agrees on.
NUMBER = r"(?:0|[1-9][0-9]*)"
STRICT_VERSION = rf"{NUMBER}\.{NUMBER}\.{NUMBER}(?:-(?:alpha|beta|rc)\.{NUMBER})?"
RELEASE_VERSION = r"[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?"
VERSION_GRAMMARS = {
    "strict": STRICT_VERSION,
    "release": RELEASE_VERSION,
    "build": r"[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z_.-]+)?",
    "tag": rf"v{RELEASE_VERSION}",
    "mirror": rf"refs/heads/release|refs/tags/v{RELEASE_VERSION}",
}
FILE_NAME = r"[a-zA-Z0-9._-]+"
MAX_FILE_BYTES = 1 << 30


def is_hex(value: ColumnLike, length: int, ignore_case: bool = False) -> Column:
    """Exactly ``length`` lower-case hex digits, or either case when asked."""
    return matches(value, f"[0-9a-f{'A-F' if ignore_case else ''}]{{{length}}}")


def is_version(value: ColumnLike, mode: str = "release") -> Column:
    return matches(value, VERSION_GRAMMARS[mode])


def is_safe_name(value: ColumnLike) -> Column:
    """A bare file name: no separators, no traversal."""
    return matches(value, FILE_NAME) & ~as_column(value).isin(".", "..")


def url_part(url: ColumnLike, part: str) -> Column:
    return F.try_parse_url(as_column(url), F.lit(part))


def url_host(url: ColumnLike) -> Column:
    """Lower-case host with a non-default port kept, credentials and the scheme's own port dropped."""
    own_port = F.when(F.lower(url_part(url, "PROTOCOL")) == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = F.regexp_replace(F.lower(url_part(url, "AUTHORITY")), r"\A.*@", "")
    return _drop_suffix(host, own_port)


def _drop_suffix(value: Column, suffix: Column) -> Column:
    return F.when(F.endswith(value, suffix), F.left(value, F.length(value) - F.length(suffix))).otherwise(value)


def check_origin(url: ColumnLike, hosts: Sequence[str], default: str | None = None) -> Column:
    """First rule a service origin breaks, or null when it is acceptable.

    A blank value stands for ``default`` (the first allowed host when not given).
    """
    fallback = default or f"https://{hosts[0]}"
    raw = F.btrim(as_column(url))
    value = F.when(raw.isNull() | (raw == ""), F.lit(fallback)).otherwise(raw)

    def present(part: str) -> Column:
        return F.coalesce(url_part(value, part), F.lit("")) != ""

    return first_of(
        (url_part(value, "PROTOCOL").isNull() | url_part(value, "AUTHORITY").isNull(), "invalid_url"),
        (F.lower(url_part(value, "PROTOCOL")) != "https", "protocol"),
        (~url_host(value).isin(*[h.lower() for h in hosts]), "host"),
        (F.regexp_replace(F.coalesce(url_part(value, "USERINFO"), F.lit("")), ":", "") != "", "credentials"),
        (present("QUERY"), "query"),
        (~F.coalesce(url_part(value, "PATH"), F.lit("")).isin("", "/"), "path"),
        (present("REF"), "fragment"),
    )


# Accepted shapes of configuration fields.
FIELD_SHAPES = {
    "loopback": r"127\.0\.0\.1:[0-9]{1,5}",
    "absolute_path": r"/[a-zA-Z0-9/_.-]+",
    "config_path": r"/[a-zA-Z0-9_.-]+(?:/.*)?",
    "host": r"[a-zA-Z0-9][a-zA-Z0-9.-]*",
    "host_name": r"[a-zA-Z0-9][a-zA-Z0-9.-]+",
    "service_name": r"[a-z][a-z0-9-]+",
    "unit_name": r"[a-zA-Z0-9_-]+",
    "project_name": r"[a-z0-9_-]+",
    "login_name": r"[a-z_][a-z0-9_-]*",
    "network_name": r"[a-zA-Z0-9][a-zA-Z0-9_.-]*",
    "https_origin": r"https://[a-zA-Z0-9.-]+(?::[0-9]+)?/?",
    "web_origin": r"https?://[a-zA-Z0-9.-]+(?::[0-9]+)?/?",
    "email": rf"[^@{SPACE}]+@[^@{SPACE}]+\.[^@{SPACE}]+",
    "cidr": r"[0-9a-fA-F:./]+",
}
SMTP_SHAPE = r"smtps?://.+"
SMTP_FORBIDDEN_FLAGS = ("skip_ssl_verify=true", "disable_starttls=true")


def field_rule(kind: str, value: ColumnLike, *, limit: int = 12, repository: str = "") -> Column:
    """Whether a configuration field has the accepted shape.

    ``limit`` is the length cap of ``short_name``; ``repository`` the image name ``image_pin`` must carry.
    """
    column = as_column(value)
    if kind in ("port", "unprivileged_port"):
        number = column.try_cast("bigint")
        return F.coalesce(number.between(1 if kind == "port" else 1025, 65535), F.lit(False))
    if kind == "image_pin":
        escaped = "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in repository)
        return matches(column, rf"{escaped}:[a-zA-Z0-9_.-]+")
    if kind == "smtp_uri":
        safe = matches(column, SMTP_SHAPE)
        for flag in SMTP_FORBIDDEN_FLAGS:
            safe = safe & ~F.contains(column, F.lit(flag))
        return F.coalesce(safe, F.lit(False))
    if kind == "short_name":
        return F.coalesce(F.char_length(column).between(1, limit), F.lit(False))
    if kind == "cidr":
        return matches(column, FIELD_SHAPES["cidr"]) & ~column.rlike(r"/0+\z")
    return matches(column, FIELD_SHAPES[kind])


@dataclass(frozen=True)
class PathPolicy:
    """Which paths must stay out of a shared tree. A project names its own in the first four, which are empty here."""

    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    path_patterns: tuple[str, ...] = ()
    name_patterns: tuple[str, ...] = ()
    # Names and suffixes of keys, states, databases and key stores.
    names: tuple[str, ...] = ("local.properties", "kubeconfig", "talosconfig")
    key_suffix: str = r"\.(?:key|pem|tfstate)(?:\.|\z)"
    database_suffix: str = r"\.(?:sqlite3?|db|dump|sql\.gz)\z"
    keystore_suffix: str = r"\.(?:jks|keystore|p12|pfx)\z"
    segments: tuple[str, ...] = (".terraform",)


def classify_path(path: ColumnLike, policy: PathPolicy = PathPolicy()) -> Column:
    """Name of the first policy rule a path falls under, null when the path may be shared."""
    p = as_column(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)

    def any_of(conditions: list[Column]) -> Column:
        result = F.lit(False)
        for condition in conditions:
            result = result | condition
        return result

    return first_of(
        (p.isin(*policy.exact), "exact"),
        (any_of([p.startswith(x) for x in policy.prefixes]), "prefix"),
        (any_of([p.rlike(x) for x in policy.path_patterns]), "path_pattern"),
        (any_of([name.rlike(x) for x in policy.name_patterns]), "name_pattern"),
        (F.contains(name, F.lit(".private.")), "private_marker"),
        ((name == ".env") | (name.startswith(".env.") & ~name.endswith(".example")), "environment"),
        (name.rlike(policy.key_suffix), "key_or_state"),
        (name.rlike(policy.database_suffix), "database"),
        (name.rlike(policy.keystore_suffix), "keystore"),
        (name.isin(*policy.names), "name"),
        (any_of([F.array_contains(parts, s) for s in policy.segments]), "segment"),
    )

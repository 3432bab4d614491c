"""Text rules: change titles, redaction, descriptions, codes, first lines, path rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.columns import SPACE, WORD_END, WORD_START, ColumnLike, as_column, first_of
from attest.functions.predicates import is_version

# The emoji that belongs to each change type.
CHANGE_EMOJI = {
    "feat": "✨",
    "fix": "\U0001f41b",
    "docs": "\U0001f4dd",
    "refactor": "♻️",
    "perf": "⚡",
    "test": "✅",
    "chore": "\U0001f527",
    "ci": "\U0001f477",
    "build": "\U0001f680",
    "revert": "⏪",
}
# The shape of a change title and its longest length in code points.
TITLE_SHAPE = (
    rf"\A([^{SPACE}]+) \[v([^\]]+)\] ([a-z]+)(?:\(([a-z0-9][a-z0-9/-]*)\))?(!)?: ([^{SPACE}].*)\z"
)
TITLE_LIMIT = 100


@dataclass(frozen=True)
class Secret:
    """A pattern to mask, and lower-case texts one of which every match contains.

    ``needs`` spares texts without any of them the pattern, which is most texts.
    """

    pattern: str
    needs: tuple[str, ...] = ()


# Token shapes that must never reach a log, and what replaces them.
TOKEN_PATTERNS = (
    Secret(rf"(?:glpat-|ghp_|github_pat_|bearer[{SPACE}]+)[A-Za-z0-9_.-]+", ("glpat-", "ghp_", "github_pat_", "bearer")),
)
MASK = "[REDACTED]"
# Fixed value: the longest description a status service takes.
DESCRIPTION_LIMIT = 255


def first_line(text: ColumnLike) -> Column:
    return F.element_at(F.split(as_column(text), r"\r?\n", 2), 1)


def parse_change_title(message: ColumnLike, expected_version: ColumnLike) -> Column:
    """Struct of the title's fields and ``problem``, the first rule it breaks (null when none)."""
    subject = first_line(message)
    expected = as_column(expected_version)

    # One pass of the pattern: its six groups become six lines, which a title cannot contain itself.
    parts = F.split(F.regexp_replace(subject, TITLE_SHAPE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    shaped = F.coalesce(F.size(parts) == 6, F.lit(False))

    def group(i: int) -> Column:
        return F.when(shaped, F.element_at(parts, i)).otherwise("")

    emoji_of = F.create_map(*[F.lit(x) for pair in CHANGE_EMOJI.items() for x in pair])
    return F.struct(
        group(1).alias("emoji"),
        group(2).alias("version"),
        group(3).alias("type"),
        group(4).alias("scope"),
        (group(5) == "!").alias("breaking"),
        group(6).alias("summary"),
        first_of(
            (~is_version(expected, "strict"), "expected_version"),
            (~shaped, "shape"),
            (F.coalesce(F.element_at(emoji_of, group(3)), F.lit("")) != group(1), "emoji"),
            (group(2) != expected, "version"),
            (F.char_length(subject) > TITLE_LIMIT, "length"),
            (subject.rlike(rf"\A[{SPACE}]|[{SPACE}]\z"), "outer_space"),
        ).alias("problem"),
    )


def redact(
    text: ColumnLike, literals: Sequence[str] = (), patterns: Sequence[str | Secret] = TOKEN_PATTERNS
) -> Column:
    """Mask known secrets longer than three characters, then anything shaped like a token, in any case.

    ``literals`` is configuration (a handful of secrets of one deployment), held in the plan itself.
    """
    result = as_column(text)
    for secret in literals:
        if len(secret) > 3:
            result = F.replace(result, F.lit(secret), F.lit(MASK))
    for secret in patterns:
        secret = secret if isinstance(secret, Secret) else Secret(secret)
        masked = F.regexp_replace(result, f"(?i){secret.pattern}", MASK)
        if secret.needs:
            lowered = F.lower(result)
            likely = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in secret.needs])
            masked = F.when(likely, masked).otherwise(result)
        result = masked
    return result


def describe_run(source: ColumnLike, workflow: ColumnLike, status: ColumnLike, conclusion: ColumnLike) -> Column:
    """``source [workflow]: status (conclusion)`` cut to the status service's limit."""
    ending = as_column(conclusion)
    suffix = F.when(ending.isNotNull() & (ending != ""), F.concat(F.lit(" ("), ending, F.lit(")"))).otherwise(F.lit(""))
    text = F.concat(as_column(source), F.lit(" ["), as_column(workflow), F.lit("]: "), as_column(status), suffix)
    return F.left(text, F.lit(DESCRIPTION_LIMIT))


def extract_code(text: ColumnLike) -> Column:
    """First stand-alone run of six digits, null when there is none."""
    found = F.regexp_extract(as_column(text), rf"{WORD_START}[0-9]{{6}}{WORD_END}", 0)
    return F.when(found != "", found)


def rewrite_path(path: ColumnLike, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply the first rewrite whose pattern matches the whole path; others leave it unchanged."""
    p = as_column(path)
    chain = None
    for pattern, replacement in rules:
        whole = rf"\A(?:{pattern})\z"
        step = F.regexp_replace(p, whole, replacement)
        chain = F.when(p.rlike(whole), step) if chain is None else chain.when(p.rlike(whole), step)
    return p if chain is None else chain.otherwise(p)


def document_rewrites(route: str, content_route: str, negotiated: bool = False) -> list[tuple[str, str]]:
    """Rewrites of a documentation site: the ``.md`` suffix first, the negotiated form second."""
    target = f"{content_route}$1/content.md"
    rules = [(rf"{route}((?:/[^/]+)*)\.md", target)]
    if negotiated:
        rules.append((rf"{route}((?:/[^/]+)*)/?", target))
    return rules

"""Conformance of JSON objects to a declared shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.functions.predicates import field_rule
from attest.operators.rules import Rule, check

# Fixed value: the longest accepted address.
MAX_EMAIL = 254

TYPES = {
    "string": r"\ASTRING\z", "number": r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z", "boolean": r"\ABOOLEAN\z",
    "object": r"\AOBJECT<", "array": r"\AARRAY<",
}


def conform_rules(
    json: ColumnLike,
    required: Sequence[str],
    allowed: Sequence[str],
    max_length: Mapping[str, int] | None = None,
    formats: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
) -> list[Rule]:
    """Rules of one JSON object: parseable, required keys, no other keys, types, lengths, formats.

    ``types`` names string, number, boolean, object or array; a JSON null is present and of none of them. Length and
    format judge a value only where it is present.
    """
    column = as_column(json)
    keys = F.json_object_keys(column)

    def value(name: str):
        return F.get_json_object(column, f"$['{name}']")

    rules = [Rule("object", keys.isNotNull(), column)]
    rules += [Rule(f"required:{k}", keys.isNull() | F.array_contains(keys, k)) for k in required]
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
    rules.append(Rule("additional", keys.isNull() | (F.size(extra) == 0), F.array_join(F.array_sort(extra), ",")))
    parsed = F.try_parse_json(column)
    for k, kind in (types or {}).items():
        found = F.schema_of_variant(F.try_variant_get(parsed, f'$["{k}"]', "variant"))
        right = F.coalesce(found.rlike(TYPES[kind]), F.lit(False))
        rules.append(Rule(f"type:{k}", keys.isNull() | ~F.array_contains(keys, k) | right, found))
    rules += [
        Rule(f"length:{k}", value(k).isNull() | (F.char_length(value(k)) <= n), F.char_length(value(k)))
        for k, n in (max_length or {}).items()
    ]
    rules += [
        Rule(f"format:{k}", value(k).isNull() | field_rule(kind, value(k)), value(k))
        for k, kind in (formats or {}).items()
    ]
    return rules


def conform(df: DataFrame, json: ColumnLike, key: Sequence[str], **shape) -> DataFrame:
    """Violations of a declared shape."""
    return check(df, conform_rules(json, **shape), key)


def identity_violations(df: DataFrame, traits: ColumnLike, key: Sequence[str]) -> DataFrame:
    """An identity has exactly an e-mail address of at most ``MAX_EMAIL`` characters."""
    return conform(df, traits, key, required=["email"], allowed=["email"],
                   max_length={"email": MAX_EMAIL}, formats={"email": "email"}, types={"email": "string"})

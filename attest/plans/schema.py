"""Violations of a declared JSON Schema, compiled to one expression over VARIANT.

The whole schema, nested objects and arrays included, becomes a single column: a table is read once, nothing is
shuffled and no Python runs. Each violation has the path of the value in its document, such as ``$.user.tags[3]``.
A text is parsed once and an object or array opened once, whatever the number of keywords that look at it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.functions.predicates import field_rule

_VIOLATIONS = "array<struct<path:string,keyword:string,value:string>>"
# Types of VARIANT by their names in JSON Schema; an integer is a number without a fraction.
_KINDS: dict[str, Callable[[Column], Column]] = {
    "string": lambda kind: kind == "STRING",
    "number": lambda kind: kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
    "boolean": lambda kind: kind == "BOOLEAN",
    "null": lambda kind: kind == "VOID",
    "object": lambda kind: kind.startswith("OBJECT<"),
    "array": lambda kind: kind.startswith("ARRAY<"),
}
_OF_OBJECTS, _OF_ARRAYS = ("properties", "required", "additionalProperties"), ("items", "minItems", "maxItems")
#: Keywords that assert something and are not compiled; a schema with one of them is refused rather than half obeyed.
REFUSED = ("anyOf", "oneOf", "not", "if", "then", "else", "patternProperties", "propertyNames", "dependencies", "dependentRequired",
           "dependentSchemas", "contains", "uniqueItems", "minProperties", "maxProperties", "prefixItems", "additionalItems",
           "unevaluatedItems", "unevaluatedProperties", "multipleOf", "$dynamicRef", "$recursiveRef")


def schema_violations(df: DataFrame, json: ColumnLike, schema: Mapping, key: Sequence[str]) -> DataFrame:
    """One row per violation: key columns, ``path``, ``keyword`` and ``value``.

    A null text, and one that is not JSON, breaks the keyword ``json``. A keyword judges only values of the type that it is
    about, as the standard says: a bound says nothing of a string. Unknown keywords are annotations; those of
    ``REFUSED``, references outside the schema and schemas that contain themselves raise ``ValueError``.
    """
    text = as_column(json)
    compiler = _Compiler(schema)
    found = _with(F.try_parse_json(text), lambda parsed: F.when(parsed.isNull(), _one(F.lit("$"), "json", text)).otherwise(
        compiler.violations(schema, parsed, F.lit("$"), ())))
    return df.select(*key, F.explode(found).alias("__v")).select(*key, "__v.*")


def _one(path: Column, keyword: str, value: Column) -> Column:
    row = F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), value.cast("string").alias("value"))
    return F.array(row).cast(_VIOLATIONS)


def _none() -> Column:
    return F.array().cast(_VIOLATIONS)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """The array that ``use`` makes of a value that is computed once, however often ``use`` names it."""
    return F.flatten(F.transform(F.array(value), use))


@dataclass(frozen=True)
class _Value:
    """A value, the name of its type, and its fields or items, null where it has none or its schema does not ask."""

    node: Column
    kind: Column
    members: Column
    items: Column


class _Compiler:
    def __init__(self, root: Mapping):
        self.root = root

    def violations(self, schema: Mapping | bool, node: Column, path: Column, within: tuple[str, ...]) -> Column:
        """Violations of one value; an absent one (SQL null) has none."""
        if schema is True:
            return _none()
        if schema is False:
            return F.when(node.isNotNull(), _one(path, "false", _text(node))).otherwise(_none())
        for name in REFUSED:
            if name in schema:
                raise ValueError(f"keyword {name} is not compiled")
        no_members, no_items = F.lit(None).cast("map<string,variant>"), F.lit(None).cast("array<variant>")
        if not any(k in schema for k in (*_OF_OBJECTS, *_OF_ARRAYS)):
            return _with(F.schema_of_variant(node), lambda k: self._all(schema, _Value(node, k, no_members, no_items), path, within))
        members = node.try_cast("map<string,variant>") if any(k in schema for k in _OF_OBJECTS) else no_members
        items = node.try_cast("array<variant>") if any(k in schema for k in _OF_ARRAYS) else no_items

        def judged(opened: Column) -> Column:
            members, items = opened["members"], opened["items"]
            # An opened value tells its type; the name of the type is a walk through all of it.
            kind = F.when(members.isNotNull(), "OBJECT<").when(items.isNotNull(), "ARRAY<").otherwise(F.schema_of_variant(node))
            return _with(kind, lambda k: self._all(schema, _Value(node, k, members, items), path, within))

        return _with(F.struct(members.alias("members"), items.alias("items")), judged)

    def _all(self, schema: Mapping, value: _Value, path: Column, within: tuple[str, ...]) -> Column:
        node = value.node
        parts = [F.when(node.isNotNull() & ~F.coalesce(ok, F.lit(False)), _one(path, keyword, _text(node))).otherwise(_none())
                 for keyword, ok in self._assertions(schema, value)]
        parts += self._members(schema, value, path, within)
        parts += [self.violations(s, node, path, within) for s in schema.get("allOf", ())]
        if "$ref" in schema:
            target = schema["$ref"]
            if target in within:
                raise ValueError(f"{target} contains itself")
            parts.append(self.violations(self._resolved(target), node, path, (*within, target)))
        if not parts:
            return _none()
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def _resolved(self, target: str) -> Mapping | bool:
        if target != "#" and not target.startswith("#/"):
            raise ValueError(f"{target} lies outside the schema")
        found = self.root
        for step in target.split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(found, Mapping) or step not in found:
                raise ValueError(f"{target} is not in the schema")
            found = found[step]
        return found

    def _assertions(self, schema: Mapping, value: _Value) -> list[tuple[str, Column]]:
        """Keywords about the value itself, with whether it holds."""
        node = value.node
        made: list[tuple[str, Column]] = []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            made.append(("type", _any([_is(value, n) for n in names])))
        for keyword in ("enum", "const"):
            if keyword in schema:
                values = schema[keyword] if keyword == "enum" else [schema[keyword]]
                made.append((keyword, _any([_equals(value, v) for v in values])))
        text, number = _text(node), _number(node)
        length, n_items = F.char_length(text), F.size(value.items)
        bounds: dict[str, tuple[str, Callable[[Column | str], Column]]] = {
            "minLength": ("string", lambda n: length >= n),
            "maxLength": ("string", lambda n: length <= n),
            "pattern": ("string", lambda p: text.rlike(p)),
            "minimum": ("number", lambda n: number >= n),
            "maximum": ("number", lambda n: number <= n),
            "exclusiveMinimum": ("number", lambda n: number > n),
            "exclusiveMaximum": ("number", lambda n: number < n),
            "minItems": ("array", lambda n: n_items >= n),
            "maxItems": ("array", lambda n: n_items <= n),
            "format": ("string", lambda kind: field_rule(kind, text)),
        }
        for keyword, (kind, holds) in bounds.items():
            if keyword in schema:
                bound = schema[keyword]
                made.append((keyword, ~_is(value, kind) | holds(bound if isinstance(bound, str) else F.lit(float(bound)))))
        return made

    def _members(self, schema: Mapping, value: _Value, path: Column, within: tuple[str, ...]) -> list[Column]:
        """Violations of an object's fields and an array's items."""
        parts = []
        fields = schema.get("properties", {})
        members = value.members
        keys = F.map_keys(members)
        for name in schema.get("required", ()):
            lacking = members.isNotNull() & ~F.array_contains(keys, name)
            parts.append(F.when(lacking, _one(_step(path, name), "required", F.lit(None))).otherwise(_none()))
        for name, inner in fields.items():
            parts.append(self.violations(inner, F.try_element_at(members, F.lit(name)), _step(path, name), within))
        others = schema.get("additionalProperties", True)
        if others is not True:
            extra = F.array_sort(F.filter(keys, lambda k: ~k.isin(*fields)) if fields else keys)
            judged = F.transform(extra, lambda k: self._other(others, F.try_element_at(members, k), F.concat(path, F.lit("."), k), within))
            parts.append(F.coalesce(F.flatten(judged), _none()))
        if "items" in schema:
            judged = F.transform(value.items, lambda item, i: self.violations(
                schema["items"], item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), within))
            parts.append(F.coalesce(F.flatten(judged), _none()))
        return parts

    def _other(self, schema: Mapping | bool, node: Column, path: Column, within: tuple[str, ...]) -> Column:
        if schema is False:
            return _one(path, "additionalProperties", _text(node))
        return self.violations(schema, node, path, within)


def _step(path: Column, name: str) -> Column:
    return F.concat(path, F.lit("." + name))


def _text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _number(node: Column) -> Column:
    """Numbers are compared as doubles, as most readers of JSON do."""
    return F.try_variant_get(node, "$", "double")


def _is(value: _Value, kind: str) -> Column:
    if kind == "integer":
        number = _number(value.node)
        return _is(value, "number") & (number == F.floor(number))
    if kind not in _KINDS:
        raise ValueError(f"type {kind} is unknown")
    return F.coalesce(_KINDS[kind](value.kind), F.lit(False))


def _equals(value: _Value, wanted: object) -> Column:
    if wanted is None:
        return _is(value, "null")
    if isinstance(wanted, bool):
        return _is(value, "boolean") & (F.try_variant_get(value.node, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return _is(value, "string") & (_text(value.node) == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return _is(value, "number") & (_number(value.node) == F.lit(float(wanted)))
    raise ValueError("only plain values are compared")


def _any(cases: list[Column]) -> Column:
    holds = F.lit(False)
    for case in cases:
        holds = holds | case
    return holds

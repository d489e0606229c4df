"""JSON Schema compiled to one Column: the violations of a VARIANT, each with its path.

The keywords are those of draft 7 that say something about one value by itself: type, enum, const,
pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
required, properties, additionalProperties, minProperties, maxProperties, items, minItems, maxItems,
uniqueItems, allOf, anyOf, oneOf, not. A keyword says nothing about values of a type that it is not
for. Other keywords are passed over if they are notes (title, description and the like), and are an
error of the compiler else. A schema says nothing about a field that is absent but by ``required``.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "readOnly", "writeOnly", "contentEncoding", "contentMediaType", "definitions"}
KEYWORDS = (
    "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "required", "properties",
    "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "allOf", "anyOf", "oneOf", "not",
)
VIOLATION = "struct<path: string, rule: string, value: string>"


def parsed(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; SQL null for other texts.

    The parser stops after a value, so the text is parsed inside an array and inside an object: what
    follows a value breaks one of the two.
    """
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(inside) == 1) & named.isNotNull(), F.get(inside, 0))


def kind(value: Column) -> Column:
    """null, boolean, integer, number, string, array or object; SQL null for an absent value. Whole numbers are integers however they are written."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull(), None)
        .when(name == "VOID", "null")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "STRING", "string")
        .when(F.startswith(name, F.lit("ARRAY")), "array")
        .when(F.startswith(name, F.lit("OBJECT")), "object")
        .when(number % 1 == 0, "integer")
        .otherwise("number")
    )


def _is(value: Column, *names: str) -> Column:
    return F.coalesce(kind(value).isin(*names), F.lit(False))


def _has_type(value: Column, wanted: str | list[str]) -> Column:
    names = {wanted} if isinstance(wanted, str) else set(wanted)
    return _is(value, *(names | {"integer"} if "number" in names else names))


def _equal(value: Column, literal: Any) -> Column:
    """Whether a value is the literal; numbers by value, arrays and objects by their JSON."""
    if isinstance(literal, bool):
        return _is(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(literal))
    if isinstance(literal, (int, float)):
        return _is(value, "integer", "number") & (F.try_variant_get(value, "$", "double") == F.lit(float(literal)))
    if isinstance(literal, str):
        return _is(value, "string") & (F.try_variant_get(value, "$", "string") == F.lit(literal))
    if literal is None:
        return _is(value, "null")
    return F.coalesce(F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(literal)))), F.lit(False))


def _java(pattern: str) -> str:
    re.compile(pattern)
    return pattern


def _shown(value: Column) -> Column:
    return F.substring(F.to_json(value), 1, 80)


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _fields(value: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<string>"))


def _step(name: str) -> str:
    return "['" + name.replace("'", "\\'") + "']" if not re.fullmatch(r"\w+", name) else f".{name}"


def violations(value: Column, schema: dict | bool, path: Column | str = "$") -> Column:
    """An array of (path, rule, value) for a VARIANT that is there; an absent one (SQL null) has none.

    ``rule`` is the keyword, with the name of the field for required and additionalProperties.
    ``value`` is the start of the value's JSON.
    """
    at = F.lit(path) if isinstance(path, str) else path
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return F.when(value.isNotNull(), F.array(F.struct(at.alias("path"), F.lit("false").alias("rule"), _shown(value).alias("value")))).otherwise(_none())
    unknown = set(schema) - set(KEYWORDS) - NOTES
    if unknown:
        raise ValueError(f"keywords that aren't compiled: {', '.join(sorted(unknown))}")
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    items = F.try_variant_get(value, "$", "array<variant>")
    numeric, string, array, obj = _is(value, "integer", "number"), _is(value, "string"), _is(value, "array"), _is(value, "object")
    good = {
        "type": lambda a: _has_type(value, a),
        "enum": lambda a: reduce(Column.__or__, [_equal(value, x) for x in a], F.lit(False)),
        "const": lambda a: _equal(value, a),
        "pattern": lambda a: ~string | text.rlike(_java(a)),
        "minLength": lambda a: ~string | (F.length(text) >= a),
        "maxLength": lambda a: ~string | (F.length(text) <= a),
        "minimum": lambda a: ~numeric | (number >= a),
        "maximum": lambda a: ~numeric | (number <= a),
        "exclusiveMinimum": lambda a: ~numeric | (number > a),
        "exclusiveMaximum": lambda a: ~numeric | (number < a),
        "multipleOf": lambda a: ~numeric | (number / a % 1 == 0),
        "minProperties": lambda a: ~obj | (F.size(_fields(value)) >= a),
        "maxProperties": lambda a: ~obj | (F.size(_fields(value)) <= a),
        "minItems": lambda a: ~array | (F.size(items) >= a),
        "maxItems": lambda a: ~array | (F.size(items) <= a),
        "uniqueItems": lambda a: ~array | F.lit(not a) | (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) == F.size(items)),
        "allOf": lambda a: reduce(Column.__and__, [F.size(violations(value, s, at)) == 0 for s in a], F.lit(True)),
        "anyOf": lambda a: reduce(Column.__or__, [F.size(violations(value, s, at)) == 0 for s in a], F.lit(False)),
        "oneOf": lambda a: reduce(Column.__add__, [(F.size(violations(value, s, at)) == 0).cast("int") for s in a], F.lit(0)) == 1,
        "not": lambda a: F.size(violations(value, a, at)) > 0,
    }
    found = lambda rule: F.struct(at.alias("path"), F.lit(rule).alias("rule"), _shown(value).alias("value"))
    own = [F.when(~F.coalesce(good[k](a), F.lit(False)), found(k)) for k, a in schema.items() if k in good]
    known = schema.get("properties", {})
    field = {name: F.try_variant_get(value, "$['" + name.replace("'", "\\'") + "']", "variant") for name in {*known, *schema.get("required", [])}}
    own += [F.when(obj & ~F.array_contains(_fields(value), name), found(f"required: {name}")) for name in schema.get("required", [])]
    parts = [F.array_compact(F.array(*own))] if own else []
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.array_except(_fields(value), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))
        if more is False:
            parts.append(F.when(obj, F.transform(others, lambda n: F.struct(at.alias("path"), F.concat(F.lit("additionalProperties: "), n).alias("rule"), _shown(value).alias("value")))).otherwise(_none()))
        else:
            entries = F.filter(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.array_contains(others, e["key"]))
            parts.append(F.when(obj, F.flatten(F.transform(entries, lambda e: violations(e["value"], more, F.concat(at, F.lit("."), e["key"]))))).otherwise(_none()))
    parts += [F.when(obj & F.array_contains(_fields(value), name), violations(field[name], s, F.concat(at, F.lit(_step(name))))).otherwise(_none()) for name, s in known.items()]
    if isinstance(schema.get("items"), (dict, bool)):
        each = lambda x, i: violations(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))
        parts.append(F.when(array, F.flatten(F.transform(items, each))).otherwise(_none()))
    elif "items" in schema:
        raise ValueError("items by place aren't compiled")
    return F.when(value.isNull(), _none()).otherwise(_joined(parts)) if parts else _none()


def rules(schema: dict | bool, path: str = "$") -> list[tuple[str, str]]:
    """(path, rule) of everything that the schema asks for; elements of arrays have the path ``[*]``, other fields ``.*``."""
    if isinstance(schema, bool):
        return [] if schema else [(path, "false")]
    out = [(path, k) for k in schema if k in KEYWORDS and k not in ("properties", "items", "required", "additionalProperties")]
    out += [(path, f"required: {n}") for n in schema.get("required", [])]
    more = schema.get("additionalProperties", True)
    out += [(path, "additionalProperties")] if more is False else rules(more, path + ".*")
    for name, s in schema.get("properties", {}).items():
        out += rules(s, path + _step(name))
    return out + (rules(schema["items"], path + "[*]") if isinstance(schema.get("items"), (dict, bool)) else [])

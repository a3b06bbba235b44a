"""Contracts: JSON Schema documents that records are checked against.

A contract is a plain JSON Schema object, and is compiled into an expression over the
record as VARIANT: a typed reader would hide a number where a string belongs, a
VARIANT shows every value's own kind. The expression gives all messages of a
record, each with its place, in the order of the contract, and runs in the JVM.

The keywords used by the contracts are supported: type, enum, const, required,
properties, additionalProperties, items, minItems, minLength, pattern, minimum and
maximum; ``format`` is not checked. Numbers are equal by value, so 1.0 is an integer.
A null line, text after the record, a key that an object has twice, and NaN are not JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.vocabulary import CONFIDENCES, LANGUAGES, SEVERITIES, SOURCE_TYPES

_TEXT, _TEXT_OR_NULL = {"type": "string"}, {"type": ["string", "null"]}
#: The contract of a training example.
TRAINING_EXAMPLE = {
    "type": "object",
    "required": ["language", "code", "finding", "provenance"],
    "properties": {
        "language": {"enum": list(LANGUAGES)},
        "framework": _TEXT_OR_NULL,
        "library": _TEXT_OR_NULL,
        "database": _TEXT_OR_NULL,
        "code": {"type": "string", "minLength": 1},
        "context": _TEXT,
        "evidence": {"type": "array", "items": _TEXT},
        "finding": {
            "type": "object",
            "required": ["category", "confidence", "severity", "summary"],
            "properties": {
                "category": _TEXT,
                "confidence": {"enum": list(CONFIDENCES)},
                "confidence_score": {"type": ["number", "null"], "minimum": 0, "maximum": 1},
                "severity": {"enum": list(SEVERITIES)},
                "summary": _TEXT,
                "reason": _TEXT,
                "suggested_patch": _TEXT_OR_NULL,
            },
        },
        "provenance": {
            "type": "object",
            "required": ["source_type", "source_url"],
            "properties": {"source_type": {"enum": list(SOURCE_TYPES)}, "source_url": _TEXT, "repository": _TEXT_OR_NULL, "commit": _TEXT_OR_NULL, "license": _TEXT_OR_NULL},
        },
    },
}

_COUNT = {"type": "integer", "minimum": 0}
#: The contract of a dataset manifest.
DATASET_MANIFEST = {
    "type": "object",
    "additionalProperties": False,
    "required": ["datasetId", "version", "splitSeed", "counts", "checksums"],
    "properties": {
        "$schema": _TEXT,
        "datasetId": {"type": "string", "minLength": 1},
        "version": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        "splitSeed": {"type": "integer"},
        "counts": {"type": "object", "additionalProperties": False, "required": ["train", "val", "test"], "properties": {"train": _COUNT, "val": _COUNT, "test": _COUNT}},
        "checksums": {"type": "object", "additionalProperties": False, "required": ["train", "val", "test"], "properties": {"train": _TEXT, "val": _TEXT, "test": _TEXT}},
        "sourceExamplesChecksum": _TEXT_OR_NULL,
    },
}

#: The kinds of values by the first word of their VARIANT schema.
_KINDS = {
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "null": ("VOID",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
}
#: The message of a line that is not JSON.
NOT_JSON = "record: invalid JSON"
#: Follows a record as it is parsed, to tell that nothing else does.
_AFTER = "end of the record"


def load_contract(spark: SparkSession, path: str) -> dict:
    """A JSON Schema document, from any store that Spark reads; a document is one short text."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _is(kind: Column, names: str | list[str], value: Column) -> Column:
    found = F.lit(False)
    for name in [names] if isinstance(names, str) else names:
        if name == "integer":
            number = F.try_variant_get(value, "$", "double")
            found = found | (kind.isin(*_KINDS["number"]) & (number == F.floor(number)))
        else:
            found = found | kind.isin(*_KINDS[name])
    return found


def _equals(kind: Column, value: Column, wanted: object) -> Column:
    if wanted is None or isinstance(wanted, bool):
        same = F.try_variant_get(value, "$", "boolean") == F.lit(wanted) if wanted is not None else F.lit(True)
        return _is(kind, "null" if wanted is None else "boolean", value) & same
    if isinstance(wanted, (int, float)):
        return _is(kind, "number", value) & (F.try_variant_get(value, "$", "double") == float(wanted))
    if isinstance(wanted, str):
        return _is(kind, "string", value) & (F.try_variant_get(value, "$", "string") == wanted)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _key(name: str) -> str:
    if "'" not in name:
        return f"$['{name}']"
    if '"' not in name:
        return f'$["{name}"]'
    raise ValueError(f"no path can name the key {name}")


def _messages(value: Column, rule: dict, at: Column) -> Column:
    """All messages of a value, which is no SQL null, at its place."""

    def judged(kind: Column) -> Column:
        say = lambda text: F.concat(F.when(at == "", "record").otherwise(at), F.lit(f": {text}"))
        inner = lambda name: F.concat(at, F.when(at == "", "").otherwise("."), name)
        checks: list[tuple[Column, Column]] = []
        any_of = lambda values: F.coalesce(F.greatest(*[_equals(kind, value, v) for v in values], F.lit(False), F.lit(False)), F.lit(False))
        if "enum" in rule:
            checks.append((~any_of(rule["enum"]), say("not one of the allowed values")))
        if "const" in rule:
            checks.append((~any_of([rule["const"]]), say("not the fixed value")))
        string, number = F.when(_is(kind, "string", value), F.try_variant_get(value, "$", "string")), F.when(_is(kind, "number", value), F.try_variant_get(value, "$", "double"))
        if "minLength" in rule:
            checks.append((F.length(string) < rule["minLength"], F.when(string == "", say("empty")).otherwise(say("too short"))))
        if "pattern" in rule:
            checks.append((~string.rlike(rule["pattern"]), say("does not match the pattern")))
        if "minimum" in rule:
            checks.append((number < rule["minimum"], say(f"below {rule['minimum']}")))
        if "maximum" in rule:
            checks.append((number > rule["maximum"], say(f"above {rule['maximum']}")))
        items = F.when(_is(kind, "array", value), F.try_variant_get(value, "$", "array<variant>"))
        if "minItems" in rule:
            checks.append((F.size(items) < rule["minItems"], say("too few items")))
        parts = [F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))] if checks else []
        if rule.get("items"):
            each = F.flatten(F.transform(items, lambda x, i: _messages(x, rule["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            parts.append(F.coalesce(each, _none()))
        known, rest = rule.get("properties", {}), rule.get("additionalProperties", True)
        of_object: list[Column] = []
        child = lambda name: F.variant_get(value, _key(name), "variant")
        if rule.get("required"):
            of_object.append(F.array_compact(F.array(*[F.when(child(k).isNull(), F.concat(inner(F.lit(k)), F.lit(": required"))) for k in rule["required"]])))
        member = lambda k, its: _bound(child(k), lambda c: F.when(c.isNotNull(), _messages(c, its, inner(F.lit(k)))).otherwise(_none()))
        of_object += [member(k, its) for k, its in known.items() if its]
        if rest is False or (isinstance(rest, dict) and rest):
            entries = F.try_variant_get(value, "$", "map<string,variant>")
            others = F.sort_array(F.array_except(F.map_keys(entries), F.array(*map(F.lit, known)).cast("array<string>")))
            if rest is False:
                of_object.append(F.transform(others, lambda k: F.concat(inner(k), F.lit(": unknown key"))))
            else:
                of_object.append(_bound(entries, lambda m: F.flatten(F.transform(others, lambda k: _messages(F.element_at(m, k), rest, inner(k))))))
        if of_object:
            parts.append(F.when(_is(kind, "object", value), F.concat(*of_object)).otherwise(_none()))
        said = F.concat(*parts) if parts else _none()
        if "type" not in rule:
            return said
        kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        return F.when(F.coalesce(_is(kind, kinds, value), F.lit(False)), said).otherwise(F.array(say(f"not of type {' or '.join(kinds)}")))

    return _bound(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), judged)


def parsed(raw: Column) -> Column:
    """A JSON text as VARIANT; null if it is no JSON, or more than that."""

    def alone(both: Column) -> Column:
        end = F.try_variant_get(both, "$[1]", "string")
        return F.when((F.size(F.try_variant_get(both, "$", "array<variant>")) == 2) & (end == _AFTER), F.variant_get(both, "$[0]", "variant"))

    # The parser stops at the end of a value, whatever follows; so the record is parsed with something behind it.
    return _bound(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{_AFTER}"]'))), alone)


def violations(raw: Column, contract: dict) -> Column:
    """Messages ``place: what is wrong`` of a JSON text, in the order of the contract; none for a record that keeps it."""
    return _bound(parsed(raw), lambda v: F.when(v.isNull(), F.array(F.lit(NOT_JSON))).otherwise(_messages(v, contract, F.lit(""))))

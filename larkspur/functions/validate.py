"""Casting and checking JSON values by a schema: types, nullable unions, lists of values, ranges, lengths, required and
nested fields, items."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS: dict[str, Callable[[object], bool]] = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}
# Words that stand for true and false.
_WORDS = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}


def resolved(schema: dict) -> tuple[dict, bool]:
    """(the schema of a value that isn't null, whether null is allowed): ``nullable``, a list of types with ``null``, and a
    union of one schema with null mean the same."""
    nullable = bool(schema.get("nullable"))
    for union in ("anyOf", "oneOf"):
        options = schema.get(union)
        if isinstance(options, list):
            real = [o for o in options if o.get("type") != "null"]
            if len(real) == 1 and len(real) < len(options):
                schema, nullable = {k: v for k, v in schema.items() if k != union} | real[0], True
    kind = schema.get("type")
    if isinstance(kind, list):
        real = [k for k in kind if k != "null"]
        schema, nullable = schema | {"type": real[0] if real else "null"}, nullable or "null" in kind
    return schema, nullable


def _number(text: str, make: type) -> object:
    try:
        return make(text)
    except ValueError:
        return text


def cast_value(value: object, schema: dict) -> object:
    """The value with texts turned to the numbers, truth values and objects that the schema asks for, where they can be;
    what can't be stays as it is, for the check to tell. Fields that the schema doesn't name stay too."""
    schema, _ = resolved(schema)
    kind = schema.get("type")
    if isinstance(value, dict) and kind in ("object", None):
        fields = schema.get("properties", {})
        return {k: cast_value(v, fields[k]) if k in fields else v for k, v in value.items()}
    if isinstance(value, list) and kind == "array" and "items" in schema:
        return [cast_value(v, schema["items"]) for v in value]
    if kind == "string" and value is not None and not isinstance(value, str):
        return str(value)
    if not isinstance(value, str):
        return value
    return _number(value, int) if kind == "integer" else _number(value, float) if kind == "number" else _WORDS.get(value.lower(), value) if kind == "boolean" else value


def _rules(value: object, kind: str | None) -> list[tuple[str, Callable[[object], bool]]]:
    """(key of a schema, whether the value breaks what stands there)."""
    rules: list[tuple[str, Callable]] = [("enum", lambda allowed: value not in allowed)]
    if kind in ("integer", "number"):
        rules += [("minimum", lambda m: value < m), ("maximum", lambda m: value > m)]
    if kind == "string":
        rules += [("minLength", lambda m: len(value) < m), ("maxLength", lambda m: len(value) > m)]
    return rules


def check_value(value: object, schema: dict, path: str = "") -> list[str]:
    """["path: rule"] of all that is wrong with a value, in the order of its fields; empty for a valid one."""
    schema, nullable = resolved(schema)
    if value is None and nullable:
        return []
    kind, name = schema.get("type"), path or "value"
    if kind in _KINDS and not _KINDS[kind](value):
        return [f"{name}: {kind}"]
    errors = [f"{name}: {key}" for key, broken in _rules(value, kind) if key in schema and broken(schema[key])]
    if kind == "object":
        at = lambda k: f"{path}.{k}" if path else k
        errors += [f"{at(k)}: required" for k in schema.get("required", []) if k not in value]
        fields = schema.get("properties", {})
        for k in value:
            if k in fields:
                errors += check_value(value[k], fields[k], at(k))
    if kind == "array" and "items" in schema:
        for k, item in enumerate(value):
            errors += check_value(item, schema["items"], f"{path}[{k}]")
    return errors


def validated(rows: DataFrame, key: str, payload: str, schema: dict) -> DataFrame:
    """(key, cast, errors): each JSON payload cast by the schema, as JSON, and what is wrong with it. A null payload, and one
    that isn't JSON, has the error ``value: json``. Rows of null keys are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, list[str]]] = []
            for text in batch.column("payload").to_pylist():
                try:
                    value = cast_value(json.loads(text), schema)
                    out.append((json.dumps(value, ensure_ascii=False), check_value(value, schema)))
                except (TypeError, ValueError, RecursionError):
                    out.append((None, ["value: json"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], [key, "cast", "errors"])

    kind = dict(rows.dtypes)[key]
    d = rows.where(F.col(key).isNotNull()).select(key, F.col(payload).alias("payload"))
    return d.mapInArrow(of, f"`{key}` {kind}, cast string, errors array<string>")

"""The wire filter as a JSON Schema (draft 2020-12), built from the operators and limits.

The schema is stricter than the decoder in one point: it allows no unknown keys, which the
decoder ignores.
"""

from __future__ import annotations

from ..types import FilterLimits
from . import ast


def json_schema(limits: FilterLimits = FilterLimits()) -> dict:
    ref = lambda name: {"$ref": f"#/$defs/{name}"}

    def closed(required: list[str], **properties: dict) -> dict:
        return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}

    def leaf(ops: tuple[str, ...], value: dict | None) -> dict:
        parts = {"op": {"enum": list(ops)}, "field": ref("field")}
        return closed(["op", "field", "value"], **parts, value=value) if value else closed(["op", "field"], **parts)

    text = {"type": "string", "maxLength": limits.max_string}
    scalar = {"anyOf": [text, {"type": ["number", "boolean"]}]}
    name = {"type": "string", "minLength": 1}
    plain = tuple(op for op in ast.SINGLE if op != "prefix")
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        **closed([], version={"const": "1"}, filter=ref("node")),
        "$defs": {
            "field": closed(["model", "name"], model=name, name=name),
            "node": {
                "oneOf": [
                    closed(["op", "args"], op={"enum": ["and", "or"]}, args={"type": "array", "minItems": 1, "maxItems": limits.max_args, "items": ref("node")}),
                    closed(["op", "arg"], op={"const": "not"}, arg=ref("node")),
                    leaf(plain, scalar),
                    leaf(("prefix",), text | {"minLength": 1}),
                    leaf(ast.SET, {"type": "array", "minItems": 1, "maxItems": limits.max_in, "items": scalar}),
                    leaf(ast.RANGE, {"type": "array", "minItems": 2, "maxItems": 2, "items": scalar}),
                    leaf(ast.PRESENCE, None),
                ]
            },
        },
    }

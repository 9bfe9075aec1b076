"""JSON filters: text in, tree out, with limits and exact error places."""

from __future__ import annotations

import json
from typing import Any

from ..errors import FilterError
from ..types import INT64_MAX, INT64_MIN, FilterLimits
from . import ast


def _at(pointer: str, key: object) -> str:
    return f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}"


def _integer(text: str) -> int | float:
    """Integers beyond 64 bits are read as floats."""
    n = int(text)
    return n if INT64_MIN <= n <= INT64_MAX else float(text)


def _refuse(text: str) -> Any:
    raise ValueError(f"{text} is not JSON")


def _scalar(value: Any) -> bool:
    return isinstance(value, (str, bool, int, float))


def _object(value: Any) -> bool:
    """Empty arrays pass for empty objects."""
    return isinstance(value, dict) or value == []


class Decoder:
    def __init__(self, limits: FilterLimits = FilterLimits()):
        self.limits = limits

    def decode(self, text: str) -> ast.Node | None:
        """The tree, or None for match-all."""
        size = len(text.encode("utf-8", "surrogatepass"))
        if size > self.limits.max_payload_bytes:
            raise FilterError("value_out_of_bounds", "", f"{size} bytes are more than {self.limits.max_payload_bytes}", observed=size, limit=self.limits.max_payload_bytes)
        if not text.lstrip(" \t\n\r\0\x0b").startswith("{"):
            raise FilterError("envelope_malformed", "", "not a JSON object")
        try:
            envelope = json.loads(text, parse_int=_integer, parse_constant=_refuse)
        except (ValueError, RecursionError) as e:
            raise FilterError("envelope_malformed", "", f"not JSON: {e}") from None
        if "version" in envelope and envelope["version"] != "1":
            raise FilterError("version_unsupported", "/version", 'only version "1" is known', received=envelope["version"])
        if "filter" not in envelope:
            return None
        root = envelope["filter"]
        if root is None:
            raise FilterError("node_malformed", "/filter", "leave the key out to match everything")
        if not _object(root):
            raise FilterError("envelope_malformed", "/filter", "not a JSON object")
        self._nodes = 0
        return self._node(root, "/filter", 1)

    def _node(self, raw: Any, at: str, depth: int) -> ast.Node:
        self._nodes += 1
        if self._nodes > self.limits.max_nodes:
            raise FilterError("node_count_exceeded", at, f"more than {self.limits.max_nodes} nodes", limit=self.limits.max_nodes)
        if depth > self.limits.max_depth:
            raise FilterError("nesting_too_deep", at, f"deeper than {self.limits.max_depth}", limit=self.limits.max_depth)
        op = raw.get("op") if isinstance(raw, dict) else None
        if not isinstance(op, str):
            raise FilterError("node_malformed", at, 'a node needs a string "op"')
        if op in ("and", "or"):
            args = tuple(self._child(c, _at(_at(at, "args"), i), depth) for i, c in enumerate(self._args(raw, at)))
            return ast.And(args) if op == "and" else ast.Or(args)
        if op == "not":
            if "arg" not in raw:
                raise FilterError("node_malformed", at, '"not" needs "arg"')
            return ast.Not(self._child(raw["arg"], _at(at, "arg"), depth))
        if op not in ast.LEAF_OPS:
            raise FilterError("operator_unknown", _at(at, "op"), f"unknown operator {op!r}", received=op)
        return self._leaf(op, raw, at)

    def _child(self, raw: Any, at: str, depth: int) -> ast.Node:
        if not _object(raw):
            raise FilterError("node_malformed", at, "not a JSON object")
        return self._node(raw, at, depth + 1)

    def _args(self, raw: dict, at: str) -> list:
        args = raw.get("args")
        if "args" not in raw:
            raise FilterError("node_malformed", at, 'needs "args"')
        at = _at(at, "args")
        if not isinstance(args, list) and args != {}:
            raise FilterError("node_malformed", at, "not a JSON array")
        if not args:
            raise FilterError("value_count_mismatch", at, "needs at least one child")
        if len(args) > self.limits.max_args:
            raise FilterError("value_out_of_bounds", at, f"more than {self.limits.max_args} children", observed=len(args), limit=self.limits.max_args)
        return args

    def _leaf(self, op: str, raw: dict, at: str) -> ast.Leaf:
        field = self._field(raw, at)
        if op in ast.PRESENCE:
            if "value" in raw:
                raise FilterError("value_unexpected", _at(at, "value"), f"{op} takes no value")
            return ast.Leaf(op, field)
        if "value" not in raw:
            raise FilterError("node_malformed", at, f"{op} needs a value")
        value, at = raw["value"], _at(at, "value")
        if op in ast.SET:
            return ast.Leaf(op, field, self._set(op, value, at))
        if op in ast.RANGE:
            return ast.Leaf(op, field, self._range(value, at))
        return ast.Leaf(op, field, self._single(op, value, at))

    def _field(self, raw: dict, at: str) -> ast.FieldRef:
        if "field" not in raw:
            raise FilterError("node_malformed", at, 'a leaf needs "field"')
        field, at = raw["field"], _at(at, "field")
        if not _object(field):
            raise FilterError("node_malformed", at, 'an object with "model" and "name"')
        field = field or {}
        for key in ("model", "name"):
            if not isinstance(field.get(key), str) or not field[key]:
                raise FilterError("node_malformed", _at(at, key), "a string that is not empty")
        return ast.FieldRef(field["model"], field["name"])

    def _text(self, value: Any, at: str) -> None:
        if isinstance(value, str) and len(value) > self.limits.max_string:
            raise FilterError("value_out_of_bounds", at, f"longer than {self.limits.max_string}", observed=len(value), limit=self.limits.max_string)

    def _single(self, op: str, value: Any, at: str) -> Any:
        if not _scalar(value) or op == "prefix" and not isinstance(value, str):
            raise FilterError("node_malformed", at, f"{op} takes one {'string' if op == 'prefix' else 'scalar'}")
        if op == "prefix" and not value:
            raise FilterError("value_out_of_bounds", at, "an empty prefix matches everything: leave the filter out")
        self._text(value, at)
        return value

    def _set(self, op: str, value: Any, at: str) -> tuple:
        if not isinstance(value, list) and value != {}:
            raise FilterError("node_malformed", at, f"{op} takes an array of scalars")
        if not value:
            raise FilterError("value_count_mismatch", at, f"{op} needs at least one element")
        if len(value) > self.limits.max_in:
            raise FilterError("value_out_of_bounds", at, f"more than {self.limits.max_in} elements", observed=len(value), limit=self.limits.max_in)
        kept: dict[tuple, Any] = {}
        for i, x in enumerate(value):
            if not _scalar(x):
                raise FilterError("node_malformed", _at(at, i), "not a scalar")
            self._text(x, _at(at, i))
            kept.setdefault((type(x), x), x)  # 1, 1.0, "1" and true differ
        return tuple(kept.values())

    def _range(self, value: Any, at: str) -> tuple:
        if not isinstance(value, list) and value != {}:
            raise FilterError("node_malformed", at, "between takes an array of two")
        if len(value) != 2:
            raise FilterError("value_count_mismatch", at, "between takes exactly two elements", observed=len(value))
        for i, x in enumerate(value):
            if not _scalar(x):
                raise FilterError("node_malformed", _at(at, i), "not a scalar")
            self._text(x, _at(at, i))
        return tuple(value)


def decode(text: str, limits: FilterLimits = FilterLimits()) -> ast.Node | None:
    return Decoder(limits).decode(text)


def encode(node: ast.Node | None) -> dict:
    """The wire form of a tree, as an object for ``json.dumps``."""

    def one(n: ast.Node) -> dict:
        if isinstance(n, ast.Not):
            return {"op": "not", "arg": one(n.arg)}
        if isinstance(n, (ast.And, ast.Or)):
            return {"op": "and" if isinstance(n, ast.And) else "or", "args": [one(c) for c in n.args]}
        out = {"op": n.op, "field": {"model": n.field.model, "name": n.field.name}}
        if n.op not in ast.PRESENCE:
            out["value"] = list(n.value) if isinstance(n.value, tuple) else n.value
        return out

    return {"version": "1"} | ({} if node is None else {"filter": one(node)})

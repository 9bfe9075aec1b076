"""Checks between decoding and compiling: fields, then operators, then values."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from typing import Any

from ..errors import FieldNotFilterable, FilterError, UnknownField
from ..registry import FieldView
from ..types import DATETIME, INT, INT64_MAX, INT64_MIN, NUMERIC, STRING, FilterLimits
from . import ast

RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(Z|[+-]\d\d:\d\d)", re.ASCII)


def parse_rfc3339(text: str) -> datetime | None:
    """The instant in UTC without zone, or None."""
    m = RFC3339.fullmatch(text)
    if not m:
        return None
    y, mo, d, h, mi, s, fraction, zone = m.groups()
    try:
        at = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), int((fraction or "0").ljust(6, "0")))
        if zone != "Z":
            sign = -1 if zone[0] == "-" else 1
            at -= sign * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
        return at.replace(tzinfo=timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def resolve(node: ast.Node | None, fields: dict[str, FieldView]) -> None:
    """Every name must be a field of the request's model; the model named in the filter is not looked at."""
    for leaf in ast.leaves(node):
        if leaf.field.name not in fields:
            raise UnknownField(f"no field {leaf.field.name!r}")


def not_filterable_reason(view: FieldView) -> str | None:
    if not view.field.filterable:
        return "not_filterable"
    if view.slot is None:
        return "unmapped"
    return None if view.typed else view.slot.status


def check_capability(node: ast.Node | None, fields: dict[str, FieldView], operators: frozenset[str], reason: Callable[[FieldView], str | None] = not_filterable_reason) -> None:
    for leaf in ast.leaves(node):
        if leaf.op not in operators:
            raise FilterError("capability_unsupported", "", f"the driver does not support {leaf.op}", operator=leaf.op)
        why = reason(fields[leaf.field.name])
        if why:
            raise FieldNotFilterable(leaf.field.name, why)


def _fault(declared: str, value: Any, limits: FilterLimits) -> str | None:
    """The error code of a value, or None."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if declared == STRING:
        return "value_type_mismatch" if not isinstance(value, str) else "value_out_of_bounds" if len(value) > limits.max_string else None
    if declared == INT:
        if not number or isinstance(value, float) and (not math.isfinite(value) or value != math.floor(value)):
            return "value_type_mismatch"
        return None if INT64_MIN <= int(value) <= INT64_MAX else "value_out_of_bounds"
    if declared == NUMERIC:
        return None if number and math.isfinite(value) else "value_type_mismatch"
    assert declared == DATETIME
    return None if isinstance(value, str) and parse_rfc3339(value) is not None else "value_type_mismatch"


def check_values(node: ast.Node | None, fields: dict[str, FieldView], limits: FilterLimits = FilterLimits()) -> None:
    for leaf in ast.leaves(node):
        declared = fields[leaf.field.name].field.declared_type
        if leaf.op in ast.PRESENCE:
            continue
        for value in leaf.value if isinstance(leaf.value, tuple) else (leaf.value,):
            code = "value_type_mismatch" if leaf.op == "prefix" and declared != STRING else _fault(declared, value, limits)
            if code:
                raise FilterError(code, "", f"{leaf.field.name} is {declared}", field=leaf.field.name, declared_type=declared)


def validate(node: ast.Node | None, fields: dict[str, FieldView], operators: frozenset[str] = frozenset(ast.LEAF_OPS), limits: FilterLimits = FilterLimits()) -> None:
    resolve(node, fields)
    check_capability(node, fields, operators)
    check_values(node, fields, limits)

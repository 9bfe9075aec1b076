"""Filter trees to Columns.

A leaf matches a record if the field's group was written for it and the comparison is true,
so leaves have two values.  Comparisons imply a value and with it the group; only ``is_null``
needs the group's presence column.  AND and OR are monotone, so they may stay in three-valued
logic; NOT alone must see null as false.  Leaves are left bare for Parquet to push down.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import FieldView
from ..types import DATETIME, INT, NUMERIC, STRING, Settings
from . import ast
from .preflight import parse_rfc3339


def literal(declared: str, value: Any) -> Column:
    if declared == DATETIME:
        return F.lit(parse_rfc3339(value)).cast("timestamp_ntz")
    if declared == INT:
        return F.lit(int(value)).cast("bigint")
    if declared == NUMERIC:
        return F.lit(float(value))
    return F.lit(value)


def _leaf(leaf: ast.Leaf, view: FieldView, settings: Settings) -> Column:
    declared = view.field.declared_type
    c = F.col(view.column)
    if leaf.op == "is_not_null":
        return c.isNotNull()
    if leaf.op == "is_null":
        return c.isNull() if settings.absent_is_null else F.col(view.group) & c.isNull()
    if declared == STRING and settings.collation:
        c = F.collate(c, settings.collation)
    lit = lambda v: literal(declared, v)
    if leaf.op in ast.SET:
        if declared == INT:  # one expression text instead of a call to the JVM for each of up to 1,024 values
            inside = F.expr(f"{view.column} IN ({', '.join(f'{int(v)}L' for v in leaf.value)})")
        else:
            inside = c.isin([lit(v) for v in leaf.value])
        return inside if leaf.op == "in" else ~inside
    if leaf.op == "between":
        return c.between(lit(leaf.value[0]), lit(leaf.value[1]))
    if leaf.op == "prefix":
        return c.startswith(lit(leaf.value))
    v = lit(leaf.value)
    return {"eq": c == v, "neq": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[leaf.op]


def compile_filter(node: ast.Node | None, fields: dict[str, FieldView], settings: Settings = Settings()) -> Column | None:
    """None: everything matches."""
    if node is None:
        return None
    if isinstance(node, ast.Leaf):
        return _leaf(node, fields[node.field.name], settings)
    if isinstance(node, ast.Not):
        return ~F.coalesce(compile_filter(node.arg, fields, settings), F.lit(False))
    parts = [compile_filter(a, fields, settings) for a in node.args]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(node, ast.And) else out | p
    return out


def columns_of(node: ast.Node | None, fields: dict[str, FieldView]) -> set[str]:
    """Typed columns a filter reads."""
    return {fields[leaf.field.name].column for leaf in ast.leaves(node)}



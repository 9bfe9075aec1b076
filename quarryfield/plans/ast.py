"""Filter trees: immutable nodes that callers may also build by hand."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Union

# Operators by the shape of their value (fixed values).
SINGLE = ("eq", "neq", "lt", "lte", "gt", "gte", "prefix")
SET = ("in", "nin")
RANGE = ("between",)
PRESENCE = ("is_null", "is_not_null")
LEAF_OPS = SINGLE + SET + RANGE + PRESENCE


@dataclass(frozen=True)
class FieldRef:
    model: str
    name: str


@dataclass(frozen=True)
class Leaf:
    op: str
    field: FieldRef
    value: Any = None  # a scalar, a tuple for sets and ranges, or None


@dataclass(frozen=True)
class And:
    args: tuple["Node", ...]


@dataclass(frozen=True)
class Or:
    args: tuple["Node", ...]


@dataclass(frozen=True)
class Not:
    arg: "Node"


Node = Union[Leaf, And, Or, Not]


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, Leaf):
        return ()
    return (node.arg,) if isinstance(node, Not) else node.args


def leaves(node: Node | None) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    elif node is not None:
        for c in children(node):
            yield from leaves(c)


def size(node: Node | None) -> int:
    return 0 if node is None else 1 + sum(map(size, children(node)))


def strategy(node: Node | None) -> str:
    """The label search events carry: ``joins`` for trees of AND alone, else ``exists``."""
    if isinstance(node, (Or, Not)):
        return "exists"
    return "exists" if node is not None and any(strategy(c) == "exists" for c in children(node)) else "joins"


def all_of(nodes: list[Node]) -> Node | None:
    """Nothing for no nodes, the node itself for one, else their conjunction."""
    return None if not nodes else nodes[0] if len(nodes) == 1 else And(tuple(nodes))

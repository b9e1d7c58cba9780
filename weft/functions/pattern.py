"""The operator language for graphs, patterns and modifications.

``^`` is an undirected edge, ``>>`` and ``<<`` directed ones, ``%`` one of any
direction, ``~`` negates (or removes), and ``&`` puts an explicit edge, with a
value or a test, before the operator::

    N(0) ^ (N(1) ^ N(2))                    a path: grouping chains
    N(0) ^ N(1) ^ N(2)                      a star: a flat chain fans out
    N(0) & E().val(10) >> N(1)              an edge with a value
    N(0) & ~E() ^ n(1)                      no such edge
"""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ANY, SRC, TGT, UND, Morphism

Test = Callable[[Column], Column] | str


#: Quoted text and names of SQL, which stay as they are, or ``val`` as a name of its own.
_SQL_VAL = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|(?<![\w.])val(?!\w)""", re.S)


def test_column(test: Test, value: Column, name: str) -> Column:
    """A test as a boolean column; null is false.

    A string is SQL over ``val``. A callable takes the value's column and gives a
    column: built-in functions, or a pandas UDF for what they can't express.
    """
    if isinstance(test, str):
        return F.coalesce(F.expr(_SQL_VAL.sub(lambda m: f"`{name}`" if m[0] == "val" else m[0], test)), F.lit(False))
    return F.coalesce(test(value), F.lit(False))


class _Missing:
    def __repr__(self):
        return "MISSING"


MISSING = _Missing()


@dataclass
class Edge:
    """An edge constructor: new or wanted (``E``), or of the graph that is modified (``e``)."""

    existing: bool = False
    negated: bool = False
    value: Any = MISSING
    tests: tuple[Test, ...] = ()

    def val(self, value) -> Edge:
        out = copy(self)
        out.value = value
        return out

    def test(self, test: Test) -> Edge:
        out = copy(self)
        out.tests = (*self.tests, test)
        return out

    @property
    def has_predicate(self) -> bool:
        return bool(self.tests) or self.value is not MISSING

    def __invert__(self) -> Edge:
        out = copy(self)
        out.negated = not self.negated
        return out

    def _to(self, slot: str, other: Node) -> Link:
        if not isinstance(other, Node):
            raise TypeError(f"an edge leads to a node, not to {type(other).__name__}")
        return Link(self, slot, other)

    def __xor__(self, other):
        return self._to(UND, other)

    def __rshift__(self, other):
        return self._to(SRC, other)

    def __lshift__(self, other):
        return self._to(TGT, other)

    def __mod__(self, other):
        return self._to(ANY, other)


@dataclass
class Link:
    """An edge with its far end; the slot is seen from the near end."""

    edge: Edge
    slot: str
    node: Node


@dataclass
class Half:
    """A node with an explicit edge that has no far end yet."""

    node: Node
    edge: Edge

    def __xor__(self, other):
        return self.node._add(self.edge._to(UND, other))


@dataclass
class Node:
    """A node of a graph literal, a pattern or a modification.

    ``role``: N new, n a reference to it, X and x a context or existing node, T and
    t a node of a match, G an actual id of the searched graph.
    """

    role: str
    id: int | None = None
    negated: bool = False
    value: Any = MISSING
    tests: tuple[Test, ...] = ()
    links: list[Link] = field(default_factory=list)

    def val(self, value) -> Node:
        out = copy(self)
        out.value = value
        return out

    def test(self, test: Test) -> Node:
        out = copy(self)
        out.tests = (*self.tests, test)
        return out

    @property
    def has_predicate(self) -> bool:
        return bool(self.tests) or self.value is not MISSING

    def __invert__(self) -> Node:
        out = copy(self)
        out.negated = not self.negated
        return out

    def _add(self, link: Link) -> Node:
        if self.negated and not link.edge.negated:
            raise TypeError("a negated node can't start an edge that isn't negated")
        for near in (self, link.node):
            if near.role in "Nn" and link.edge.existing:
                raise TypeError("an existing edge has no end at a new node")
        out = copy(self)
        out.links = [*self.links, link]
        return out

    def __xor__(self, other):
        return self._add(Edge()._to(UND, other))

    def __rshift__(self, other):
        return self._add(Edge()._to(SRC, other))

    def __lshift__(self, other):
        return self._add(Edge()._to(TGT, other))

    def __mod__(self, other):
        return self._add(Edge()._to(ANY, other))

    def __and__(self, other):
        if isinstance(other, Link):
            return self._add(other)
        if isinstance(other, Edge):
            return Half(self, other)
        raise TypeError("'&' takes an edge")


def N(id: int) -> Node:
    return Node("N", id)


def N_() -> Node:
    return Node("N")


def n(id: int) -> Node:
    return Node("n", id)


def X(id: int) -> Node:
    return Node("X", id)


def x(id: int) -> Node:
    return Node("x", id)


def T(id: int) -> Node:
    return Node("T", id)


def t(id: int) -> Node:
    return Node("t", id)


def at(id: int, graph_id: int) -> Node:
    """Pattern node ``id`` pinned to node ``graph_id`` of the graph."""
    return Node("G", id).val(graph_id)


def E() -> Edge:
    return Edge()


def e() -> Edge:
    return Edge(existing=True)


@dataclass
class Cluster:
    """One ``get`` or ``ban`` with its morphism and fragments."""

    decision: str
    morphism: Morphism
    nodes: tuple[Node, ...]


def get(morphism: Morphism, *nodes: Node) -> Cluster:
    return Cluster("get", morphism, nodes)


def ban(morphism: Morphism, *nodes: Node) -> Cluster:
    return Cluster("ban", morphism, nodes)


def walk(nodes):
    """(node, None, None) for each fragment's head, then (near, link, far) for each edge, depth first."""
    for head in nodes:
        yield head, None, None
        yield from _walk(head)


def _walk(near: Node):
    for link in near.links:
        yield near, link, link.node
        yield from _walk(link.node)

"""Query trees. Immutable, with negation only on leaves, so that equal queries are equal values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from codelens.query import re2

#: Order of kinds in a normalised group; cheap tests come first.
ORDER = ("case", "lang", "repo", "file", "literal", "regex", "group")
MODIFIERS = ("case", "lang", "repo", "file")


class QueryError(ValueError):
    """The query cannot be read, or cannot be answered."""


@dataclass(frozen=True)
class Leaf:
    kind: str
    text: str
    symbol: bool = False
    negated: bool = False

    def negate(self) -> Leaf:
        return replace(self, negated=not self.negated)

    def __str__(self) -> str:
        return self.show()

    def show(self, debug: bool = False) -> str:
        prefix = f"{self.kind}:" if self.kind in MODIFIERS else "sym:" if self.symbol else ""
        body = f'"{self.text}"' if any(c in ' \t\n()"' for c in self.text) else self.text
        if debug and self.kind == "regex":
            body = f"<{self.text}>({','.join('|'.join(c) for c in re2.compile(self.text).clauses)})"
        return ("-" if self.negated else "") + prefix + body


@dataclass(frozen=True)
class Group:
    op: str  # AND, OR
    parts: tuple[Leaf | Group, ...]

    def __str__(self) -> str:
        return self.show()

    def show(self, debug: bool = False) -> str:
        return "(" + f" {self.op} ".join(p.show(debug) for p in self.parts) + ")"


Node = Leaf | Group


def leaves(node: Node | None) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    elif node is not None:
        for p in node.parts:
            yield from leaves(p)


def literals(node: Node | None) -> list[str]:
    """Distinct literal texts, in order."""
    return list(dict.fromkeys(x.text for x in leaves(node) if x.kind == "literal"))


def depth(node: Node | None) -> int:
    return 0 if node is None else 1 if isinstance(node, Leaf) else 1 + max(map(depth, node.parts))


def size(node: Node | None) -> int:
    return 0 if node is None else 1 if isinstance(node, Leaf) else 1 + sum(map(size, node.parts))


def rank(node: Node) -> tuple:
    kind = node.kind if isinstance(node, Leaf) else "group"
    return ORDER.index(kind), getattr(node, "negated", False), not getattr(node, "symbol", False), str(node)


def group(op: str, parts: list[Node]) -> Node:
    """The normal form of a group: same operators merged, repeated parts once, in order of rank, alone without brackets."""
    merged: list[Node] = []
    for p in parts:
        merged += p.parts if isinstance(p, Group) and p.op == op else [p]
    unique = sorted({str(p): p for p in merged}.values(), key=rank)
    return unique[0] if len(unique) == 1 else Group(op, tuple(unique))


def negate(node: Node) -> Node:
    """De Morgan, down to the leaves."""
    if isinstance(node, Leaf):
        return node.negate()
    return group("OR" if node.op == "AND" else "AND", [negate(p) for p in node.parts])

"""Expressions of the languages with C-like operators, by precedence climbing."""

from __future__ import annotations

from sylvan.sources.cst.base import Parser
from sylvan.sources.cst.tree import Node

#: Binding powers of binary operators shared by the languages.
POWER = {
    "||": 2, "??": 2, "&&": 3, "|": 5, "^": 6, "&": 7, "&^": 11, "==": 8, "!=": 8, "===": 8, "!==": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "<=>": 9,
    "instanceof": 9, "in": 9, "<<": 10, ">>": 10, ">>>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 13,
}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^=".split())


class Expressions(Parser):
    """Subclasses give ``primary`` and ``postfix`` and the names of nodes."""

    BINARY = "binary_expression"
    POWERS = POWER
    UNARY: dict[str, str] = {}

    def expression(self, power: float = 0, field: str | None = None) -> Node | None:
        """An expression; None (and nothing read) where none begins."""
        self.depth += 1
        try:
            node = self._expression(power)
        finally:
            self.depth -= 1
        return self.tag(node, field) if field else node

    def _expression(self, power: float) -> Node | None:
        start = self.t.start
        left = self.prefix()
        if left is None:
            return None
        while True:
            op = self.operator()
            p = self.POWERS.get(op)
            if p is None or p <= power:
                break
            self.take_operator(op)
            right = self.expression(p if op != "**" else p - 1, "right")
            left = self.node(self.binary_kind(op), start, [self.tag(left, "left"), right])
        return self.tail(left, start, power)

    def operator(self) -> str:
        t = self.t
        return t.text if t.type in ("op", "word") else ""

    def take_operator(self, op: str) -> None:
        self.next()

    def binary_kind(self, op: str) -> str:
        return self.BINARY

    def tail(self, left: Node, start: int, power: int) -> Node:
        """Assignments and conditionals after the binary operators."""
        return left

    def prefix(self) -> Node | None:
        start = self.t.start
        if self.t.type == "op" and self.t.text in self.UNARY:
            kind = self.UNARY[self.next().text]
            return self.node(kind, start, [self.expression(13, self.operand_field(kind))])
        left = self.primary()
        return None if left is None else self.suffixes(left, start)

    def operand_field(self, kind: str) -> str:
        return "argument"

    def suffixes(self, left: Node, start: int) -> Node:
        while True:
            after = self.postfix(left, start)
            if after is None:
                return left
            left = after

    def primary(self) -> Node | None:
        raise NotImplementedError

    def postfix(self, left: Node, start: int) -> Node | None:
        raise NotImplementedError

    def arguments(self, kind: str, field: str = "arguments") -> Node:
        start = self.next().start
        return self.node(kind, start, self.many(")", self.argument), field)

    def argument(self) -> Node | None:
        return self.expression()

    def parenthesized(self, kind: str = "parenthesized_expression", field: str | None = None) -> Node:
        start = self.next().start
        return self.node(kind, start, self.many(")", self.expression, (",", ";")), field)
